from tuneprep.streaming.batches import (
    read_blocks,
    read_side,
    sft_prepare_stream,
    stream_pack,
    stream_split,
    stream_take,
)

__all__ = ["read_blocks", "read_side", "sft_prepare_stream", "stream_pack", "stream_split", "stream_take"]
