"""Texts compressed for a shuffle."""

import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)
