"""Operations of a training-data pipeline over documents, vectors and chats.

Nothing else in the library imports this package. Task code is pickled by
value, so executors need numpy, pyarrow and the text libraries, not this
repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
