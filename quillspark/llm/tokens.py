"""Words of a batch of texts as numbers, with Arrow's string kernels; for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers, words in each text, dictionary): texts in lower case (A-Z), split at ASCII blanks; nulls have none."""
    # Copied first: the kernels misread a slice that was cast.
    whole = pa.concat_arrays([texts]).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole, "")))
    flat = parts.flatten()
    lengths = np.diff(parts.offsets.to_numpy())
    encoded = flat.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    del parts, flat
    ids = encoded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)
    if empty.any():  # blanks at either end leave an empty string
        keep = ~empty[ids]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(owner[keep], minlength=len(lengths))
        ids = ids[keep]
    return ids.astype(np.int32), lengths.astype(np.int64), encoded.dictionary


def hashed(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(ids: np.ndarray, lengths: np.ndarray, dictionary: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct n-word shingles of each text as sorted 64-bit hashes; a shorter text is one shingle, none without words."""
    words = hashed(dictionary)[ids] if len(ids) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - starts[:-1][owner] if len(ids) else np.zeros(0, np.int64)
    rolled = np.zeros(len(ids), np.uint64)
    size = np.minimum(lengths, n)[owner] if len(ids) else np.zeros(0, np.int64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        step = padded[k : k + len(ids)]
        rolled = np.where(k < size, mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k + 1)), rolled)
    first = place <= lengths[owner] - size if len(ids) else np.zeros(0, bool)
    rolled, owner = rolled[first], owner[first]
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    rolled, owner = rolled[new], owner[new]
    return rolled, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))])


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary cells data[starts[i]:starts[i + 1]] without a loop."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(starts, np.int64) * data.itemsize).astype(np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return out.cast(pa.binary())


def flat(cells: pa.Array | pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(data, starts) of binary cells."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks() if cells.num_chunks != 1 else cells.chunk(0)
    cells = cells.cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    raw = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(cells) else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype), (offsets - offsets[0]) // size if len(cells) else np.zeros(1, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as bytes: of all numbers the lowest bytes, then the next ones, compressed."""
    head = [f"{a.dtype.str},{len(a)}" for a in arrays]
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(";".join(head).encode() + b"\n" + b"".join(planes))


def unpacked(cell: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(cell)
    at = raw.index(b"\n")
    out, place = [], at + 1
    for part in raw[:at].decode().split(";"):
        kind, n = part.split(",")
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, dtype.itemsize * n, place).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        place += dtype.itemsize * n
    return out
