"""Token ids of whole texts, in pieces of bounded length.

Ids are those that the `tokenizers` library gives for the file, without its special tokens around a text. For byte-level
BPE as in `byte_bpe_50k.json` they are made a faster way. Its pre-tokeniser never joins characters across a single space
that stands between two non-space characters, so a text is cut there and each cut is encoded once per worker and looked up
afterwards. The lookup is cleared when full and after each task: its size is bounded and never changes a result. Texts with
other runs of white space are encoded whole; texts that hold the string of an added token, and all texts of other kinds of
tokenizer, are left to the library.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Ends each document.
END_ID = 2
CACHE_ENTRIES = 600_000
#: Letters below this are letters in every version of Unicode that a file may follow.
OLD_LETTERS = "\u0250"
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space besides the space and the line feed; texts with any of it are encoded whole.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Cuts(dict):
    """Ids of a space and what follows it, by what follows: a letters-only cut is one pre-token, with a last mark it is two."""

    def __init__(self, encode, merge):
        super().__init__()
        self.encode, self.merge = encode, merge
        self.marks = {m: encode(m) for m in ".,!"}

    def __missing__(self, cut: str) -> bytes:
        word = cut[:-1]
        if cut.isalpha() and max(cut) < OLD_LETTERS:
            ids = array("I", self.merge((" " + cut).encode())).tobytes()
        else:
            ids = self[word] + self.marks[cut[-1]] if cut[-1] in self.marks and word.isalpha() else self.encode(" " + cut)
        self[cut] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The vocabulary bounds the width of an id.
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.core, self.seen = None, {}
        if byte_level(json.loads(self.library.to_str())):
            byte_of = {c: b for b, c in enumerate(_byte_characters())}
            vocabulary = self.library.get_vocab(with_added_tokens=False)
            ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte_of for c in piece)}
            self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.seen = Cuts(self.plain, self.core._encode_single_piece)

    def plain(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without the end."""
        if not text:
            return b""
        if self.core is None or any(map(text.__contains__, self.added)):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        first = text.find(" ")
        if first < 0 or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or any(s in text for s in OTHER_SPACE):
            return self.plain(text)
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        return self.plain(text[:first]) + b"".join(map(self.seen.__getitem__, text[first + 1 :].split(" ")))


def byte_level(file: dict) -> bool:
    """Whether a tokenizer file is the plain byte-level BPE that `Encoder` has the faster way for."""
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    return plain and file["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)


def _byte_characters() -> list[str]:
    """Byte-level BPE shows each byte as a printable character: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_bytes(path: str) -> int:
    """Bytes of an id: 2 if the whole vocabulary fits, else 4."""
    return 4 if encoder(path).wide else 2


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `most` ids but the first, which holds what is over."""
    head = n % most or min(n, most)
    return [(0, head), *((s, most) for s in range(head, n, most))]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, most: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, row [, ids].

    Null text is empty text: one piece, the end id. `row` numbers the input rows, so repeated or null ids stay apart.
    ids: binary, unsigned little-endian of `id_bytes` of the tokenizer.
    """
    path = tokenizer or default_path()
    kind = f"<u{id_bytes(path)}"
    fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]
    schema, end = pa.schema(fields), np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            held = 0
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, most)):
                    part = ids[4 * s : 4 * (s + n)]
                    values = [doc, row, k, s, n, zlib.crc32(part)]
                    if with_ids:
                        values.append(np.frombuffer(part, "<u4").astype(kind).tobytes())
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                    held += n
                if held > 4_000_000:
                    yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields, strict=True)], schema=schema)
                    out, held = [[] for _ in fields], 0
            yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields, strict=True)], schema=schema)
        encoder(path).seen.clear()

    ddl = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(lambda batches: common.released(run(batches)), ddl)
