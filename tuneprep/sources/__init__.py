from tuneprep.sources.arrow_files import read_arrow, stream_arrow, write_arrow
from tuneprep.sources.datasets import (
    layout_path,
    read_split,
    read_stream,
    read_train_eval,
    split_path,
    write_prepared,
)

__all__ = [
    "layout_path",
    "read_arrow",
    "stream_arrow",
    "write_arrow",
    "read_split",
    "read_stream",
    "read_train_eval",
    "split_path",
    "write_prepared",
]
