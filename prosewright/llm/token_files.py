"""Token ids in patched frame-of-reference files.

Texts are encoded by a given public tokenizer, an end id is appended to each,
and the ids of all documents, in ascending doc_id order (nulls first), are
written to files of the shared folder, one per range partition.

A file is a run of frames. A frame: magic, counts, doc_ids, ids per document,
the byte offset of each block, the blocks. A block holds BLOCK ids: its minimum,
the width that PERCENTILE of its differences fit, the differences' low bits at
that width, and an exception list (place, whole difference) for the rest. The
offsets give access to any block without reading the others.

A task writes to a name of its own and renames at the end, so a lost or repeated
task leaves one whole file. Null texts are empty: one id. Repeated rows stay
repeated. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Cuts, remember, shared_dir

BLOCK = 128
PERCENTILE = 90
END_ID = 2
MAGIC = b"PFR1"
HEAD = "<4sIQQ"  # magic, blocks, documents, ids
#: Words whose ids a worker remembers before it starts anew.
REMEMBER = 800_000
#: and their characters: texts with a control character are one part.
REMEMBER_CHARS = 16 << 20
#: Letters, single digits, runs of marks: the tokenizer's pieces of plain text.
PIECE = re.compile(r"[^\W\d_]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Characters beyond ASCII that aren't letters, and controls.
OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f]|(?=[^\x00-\x7f])[\\W\\d]")
#: Controls that Python's split takes for blanks and the tokenizer doesn't.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def widths(diff: np.ndarray) -> np.ndarray:
    """Bits per id of each row of differences: the least that PERCENTILE of them fit."""
    need = np.where(diff > 0, np.floor(np.log2(np.maximum(diff, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    need.sort(axis=1)
    return need[:, min(BLOCK - 1, BLOCK * PERCENTILE // 100)]


def pack_bits(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK values below 2 ** w to rows of BLOCK * w / 8 bytes."""
    out = np.zeros((len(v), BLOCK * w // 64 + 1), np.uint64)
    t = np.ascontiguousarray(v.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        out[:, word] |= t[i] << np.uint64(shift)
        if shift + w > 64:
            out[:, word + 1] |= t[i] >> np.uint64(64 - shift)
    return out[:, : BLOCK * w // 64].view(np.uint8)


def unpack_bits(raw: np.ndarray, w: int) -> np.ndarray:
    t = np.ascontiguousarray(np.concatenate([raw.view(np.uint64), np.zeros((len(raw), 1), np.uint64)], axis=1).T)
    out = np.empty((BLOCK, len(raw)), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        x = t[word] >> np.uint64(shift)
        if shift + w > 64:
            x = x | (t[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return out.T


def encode_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame. doc_ids: int64, null as the smallest value."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.int64)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    w = widths(diff) if blocks else np.zeros(0, np.int64)
    over = diff >= (1 << w)[:, None]
    n_over = over.sum(axis=1)
    size = 8 + BLOCK // 8 * w + 5 * n_over  # head, packed ids, exceptions
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(int(start[-1]), np.uint8)
    at = start[:-1, None] + np.arange(8)
    body[at] = np.concatenate([low.astype("<u4").view(np.uint8).reshape(-1, 4), w.astype(np.uint8)[:, None], n_over.astype(np.uint8)[:, None], np.zeros((blocks, 2), np.uint8)], axis=1)
    for width in np.unique(w[w > 0]):
        rows = np.flatnonzero(w == width)
        body[start[rows, None] + 8 + np.arange(BLOCK // 8 * width)] = pack_bits(diff[rows] & ((1 << int(width)) - 1), int(width))
    b, place = np.nonzero(over)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        at = start[b] + 8 + BLOCK // 8 * w[b]
        body[at + nth] = place
        body[(at + n_over[b] + 4 * nth)[:, None] + np.arange(4)] = diff[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join([struct.pack(HEAD, MAGIC, blocks, len(doc_ids), n), doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), start.astype("<u8").tobytes(), body.tobytes()])


def decode_frame(read: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(doc_ids, lengths, ids) of the next frame, None at the end of the file."""
    head = read(struct.calcsize(HEAD))
    if not head:
        return None
    magic, blocks, docs, n = struct.unpack(HEAD, head)
    if magic != MAGIC:
        raise ValueError("not a frame")
    doc_ids = np.frombuffer(read(8 * docs), "<i8")
    lengths = np.frombuffer(read(8 * docs), "<i8")
    start = np.frombuffer(read(8 * (blocks + 1)), "<u8").astype(np.int64)
    body = np.frombuffer(read(int(start[-1])), np.uint8)
    return doc_ids, lengths, decode_blocks(body, start)[:n]


def decode_blocks(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``start`` (its last entry is their end)."""
    blocks = len(start) - 1
    if not blocks:
        return np.zeros(0, np.uint32)
    at = start[:-1]
    low = np.ascontiguousarray(body[at[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)
    w, n_over = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    diff = np.zeros((blocks, BLOCK), np.int64)
    for width in np.unique(w[w > 0]):
        rows = np.flatnonzero(w == width)
        diff[rows] = unpack_bits(body[at[rows, None] + 8 + np.arange(BLOCK // 8 * width)], int(width))
    b = np.repeat(np.arange(blocks), n_over)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        e = at[b] + 8 + BLOCK // 8 * w[b]
        value = np.ascontiguousarray(body[(e + n_over[b] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        diff[b, body[e + nth]] = value
    return (diff + low[:, None]).ravel().astype(np.uint32)


#: Settings of a tokenizer whose pieces never cross blanks, and are those of PIECE.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class WordEncoder:
    """Encodes texts part by part where the tokenizer has SETTINGS, else whole; parts are remembered.

    Where a text has nothing that the tokenizer treats otherwise, its parts are
    the lower-case runs of letters, single digits and runs of marks that are the
    tokenizer's own pieces, and runs of letters go to its model. In other texts
    the parts are words, or the whole text, and go to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        self.by_words = all(made.get(k) == v for k, v in SETTINGS.items()) and all(x["content"].startswith("<|") for x in made["added_tokens"])
        self.chars: dict[str, str] = {}  # a letter as the model's input has it
        self.clear()
        self.direct = self.by_words and all([t.id for t in self.tok.model.tokenize(self._piece(w))] == self.tok.encode(w, add_special_tokens=False).ids for w in ("the", "été", "größe", "señor", "слово", "語"))

    def _piece(self, word: str) -> str:
        """A lower-case word of letters after the tokenizer's own normalizing and splitting, letter by letter."""
        chars = self.chars
        for c in word:
            if c not in chars:
                ready = self.tok.normalizer.normalize_str(c) if self.tok.normalizer else c
                chars[c] = "".join(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(ready)) if self.tok.pre_tokenizer else ready
        return "".join([chars[c] for c in word])

    def clear(self) -> None:
        self.base: dict[str, int] = {}  # part of a text to its row; ids of row r: flat[ends[r] : ends[r + 1]]
        self.flat, self.ends = array("I"), array("q", [0])
        self.held = 0  # characters of the parts

    def _row(self, ids) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        return len(self.ends) - 2

    def _encoded(self, text: str) -> int:
        return self._row(self.tok.encode(text, add_special_tokens=False).ids)

    def _learn_letters(self, words: set[str]) -> None:
        """Rows of lower-case words of letters, by the tokenizer's model where its input is known."""
        tokenize, piece, flat, ends, base = self.tok.model.tokenize, self._piece, self.flat, self.ends, self.base
        for w in words:
            if self.direct and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w)):
                flat.extend([t.id for t in tokenize(w if w.isascii() else piece(w))])
                ends.append(len(flat))
                base[w] = len(ends) - 2
            else:
                base[w] = self._encoded(w)

    def _learn(self, words: set[str]) -> None:
        letters = {w for w in words if w.isalpha()}
        self._learn_letters(letters)
        for w in words - letters:
            self.base[w] = self._encoded(w)

    def _pieces(self, text: str | None) -> list[str]:
        """Parts of a text that can be encoded one by one: runs of letters and of marks where that is how it splits, else words."""
        if not text:
            return []
        if not self.by_words or ODD.search(text):
            return [text]
        if self.direct and "'" not in text and "İ" not in text and "Σ" not in text and "<|" not in text and (text.isascii() or (unicodedata.is_normalized("NFC", text) and not OTHER.search(text))):
            return PIECE.findall(text.lower())
        return text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text)."""
        if len(self.base) > REMEMBER or self.held > REMEMBER_CHARS:
            self.clear()
        split = [self._pieces(t) for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.base)
        self._learn(fresh)
        self.held += sum(map(len, fresh))
        per = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.base.__getitem__, chain.from_iterable(split)), np.int64, int(per.sum()))
        ends = np.frombuffer(self.ends, np.int64)
        start, n = ends[at], ends[at + 1] - ends[at]
        ids = np.frombuffer(self.flat, np.uint32)[_ranges(start, n)] if len(at) else np.zeros(0, np.uint32)
        cut = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per)])]
        return ids, np.diff(cut)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(lengths), np.uint32(end)), lengths + 1


def _system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


NULL_ID = -(1 << 63)


def write_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns the list of them: part, path, n_docs, n_tokens. Without ``folder`` they go when the program ends."""
    folder = folder or remember(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tokenizers
        from pyspark import TaskContext

        made = tokenizers.__dict__.setdefault("_word_encoders", {})  # lives as long as the worker
        if tokenizer not in made:
            made[tokenizer] = WordEncoder(tokenizer)
        enc = made[tokenizer]
        task = TaskContext.get()
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        path, own = f"{base}/part-{task.partitionId():06d}.pfr", f"{base}/.{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        out = None
        try:
            for batch in batches:
                texts, ids = batch.column("text"), batch.column("doc_id").fill_null(NULL_ID).to_numpy()
                size = np.cumsum(np.concatenate([[0], texts.fill_null("").cast(pa.large_string()).to_pandas().map(len).to_numpy(np.int64)]))
                lo = 0
                while lo < len(texts):
                    hi = min(max(int(np.searchsorted(size, size[lo] + (2 << 20), "right")) - 1, lo + 1), len(texts))
                    got, lengths = with_end(*enc.encode(texts.slice(lo, hi - lo).to_pylist()), end_id)
                    out = out or system.open_output_stream(own)
                    out.write(encode_frame(ids[lo:hi], lengths, got))
                    n_docs, n_ids, lo = n_docs + hi - lo, n_ids + len(got), hi
        finally:
            if out:
                out.close()
        if out:
            system.move(own, path)
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": path, "n_docs": n_docs, "n_tokens": n_ids}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = Cuts(docs.sparkSession)
    return cut(rows.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"))


def read_files(files: DataFrame, base: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                system, path = _system(f["path"])
                start = f["start"]
                with system.open_input_stream(path) as src:
                    while (frame := decode_frame(src.read)) is not None:
                        doc_ids, lengths, ids = frame
                        ends = np.cumsum(lengths)
                        raw = memoryview(ids.astype("<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                        )
                        start += int(ends[-1]) if len(ends) else 0

    return files.repartitionByRange(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
