"""Token counts of whole texts by byte-pair merging with a heap and a linked list; no ids are made.

The pairs of adjacent symbols of a pre-token that have a rank stand in a heap. The lowest rank, of equal ones the leftmost, is
popped again and again; its two symbols become one in the list, and the pairs that this makes with its neighbours are pushed.
An entry whose symbols have meanwhile changed is passed over. A pre-token of n bytes and m merges has n - m tokens.

A document is counted where it is read, in one narrow pass. Pre-tokens are those of the file's own pre-tokenizer, since its
character classes belong to a version of Unicode. It never joins characters across a single space between two others, so a
text is cut there; the counts of short cuts are kept in a worker, from task to task, in a table that is cleared when full. Long texts are taken
in pieces that end at such a space, long pre-tokens are cut between two bytes that stand side by side in no token.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import _byte_characters, byte_level, default_path

#: Entries of a worker's table of counts, and characters of a cut that enters it, at most.
KNOWN_CUTS, KNOWN_LENGTH = 1_500_000, 64
#: Characters of a text that are cut at once; bytes of a pre-token above which it is cut where no token can cross.
PIECE, LONG = 1 << 20, 1 << 12
#: Ids and places are below these powers of two, so a pair of ids is one number, and a rank and a place are.
ID_BITS, PLACE_BITS = 24, 40
#: Letters below this are letters in every version of Unicode that a file may follow.
OLD_LETTERS = "\u0250"
_beside_space = re.compile(r" \s|\s |^\s|\s$")
_counters: dict[str, "Counter"] = {}


class Cuts(dict):
    """Tokens of a space and what follows it, by what follows."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, cut: str) -> int:
        n = self.count(cut)
        if len(cut) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_CUTS:
                self.clear()
            self[cut] = n
        return n

    def count(self, cut: str) -> int:
        """A word is one pre-token with its space, a mark after it another, of one byte, and a line's end between two
        other characters is one of its own. What follows a line's end is known by that and itself: no cut begins so."""
        begin, word = (b"", cut[1:]) if cut[:1] == "\n" else (b" ", cut)
        if 0 < len(word) <= KNOWN_LENGTH:
            if word.isalpha() and max(word) < OLD_LETTERS:
                return self.counter.in_bytes(begin + word.encode())
            if word[-1] in string.punctuation and word[:-1].isalpha() and max(word) < OLD_LETTERS:
                return self[cut[:-1]] + 1
            at = word.find("\n")
            if 0 < at < len(word) - 1 and not word[at - 1].isspace() and not word[at + 1].isspace():
                return self[cut[: at + len(cut) - len(word)]] + 1 + self[word[at:]]
        return self.counter.in_pre_tokens(begin.decode() + word)


class Counter:
    """Counts of one tokenizer file: byte-level BPE, with added tokens as the library has them by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        file = json.loads(library.to_str())
        model = file["model"]
        if not byte_level(file) or model.get("ignore_merges") or len(model["vocab"]) >= 1 << ID_BITS:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what stands around them")
        self.pre_tokens = library.pre_tokenizer.pre_tokenize_str
        #: Where several added tokens begin, the longest counts.
        added = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.symbols: dict[str, int] = {s: i for s, i in model["vocab"].items() if len(s) == 1}
        if any(c not in self.symbols for c in _byte_characters()):
            raise ValueError(f"{path} lacks bytes")
        self.bytes = [self.symbols[c] for c in _byte_characters()]
        #: rank, moved up by PLACE_BITS, by pair of symbols; the merged symbol by rank.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(model["vocab"][a] << ID_BITS | model["vocab"][b], rank << PLACE_BITS)
            self.made.append(model["vocab"][a + b])
        #: Bytes that stand side by side in some token, as two characters.
        self.joined = {s[k : k + 2] for s in model["vocab"] for k in range(len(s) - 1)}
        self.cuts, self.known = Cuts(self), {}

    def merges(self, own: list[int]) -> int:
        """How many merges the symbols take; `own` is used up."""
        n, ranks, made, done, ids, places = len(own), self.ranks, self.made, 0, ID_BITS, (1 << PLACE_BITS) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [ranks[pair] | k for k, pair in enumerate([a << ids | b for a, b in zip(own, own[1:])]) if pair in ranks]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            left = entry & places
            right = after[left]
            if right >= n or (pair := own[left] << ids | own[right]) not in ranks or ranks[pair] != entry - left:
                continue  # one of the two has been merged since
            new = own[left] = made[entry >> PLACE_BITS]
            own[right] = -1
            done += 1
            further = after[left] = after[right]
            if further < n:
                before[further] = left
                if (pair := new << ids | own[further]) in ranks:
                    heappush(heap, ranks[pair] | left)
            if (earlier := before[left]) >= 0 and (pair := own[earlier] << ids | new) in ranks:
                heappush(heap, ranks[pair] | earlier)
        return done

    def in_bytes(self, data: bytes) -> int:
        """Tokens of a short pre-token."""
        return len(data) - self.merges(list(map(self.bytes.__getitem__, data)))

    def in_pre_token(self, shown: str) -> int:
        """Tokens of a pre-token, given as a printable character a byte."""
        if len(shown) <= LONG:
            return len(shown) - self.merges(list(map(self.symbols.__getitem__, shown)))
        total, begin = 0, 0
        for k in range(1, len(shown) + 1):
            if k == len(shown) or shown[k - 1 : k + 1] not in self.joined:
                total += k - begin - self.merges([self.symbols[c] for c in shown[begin:k]])
                begin = k
        return total

    def in_pre_tokens(self, text: str) -> int:
        total = 0
        for shown, _ in self.pre_tokens(text):
            n = self.known.get(shown)
            if n is None:
                n = self.in_pre_token(shown)
                if len(shown) <= KNOWN_LENGTH:
                    if len(self.known) >= KNOWN_CUTS:
                        self.known.clear()
                    self.known[shown] = n
            total += n
        return total

    def in_piece(self, text: str, after_space: bool) -> int:
        """Tokens of a text between two cuts; after_space: a space before it belongs to it."""
        if _beside_space.search(text):
            cuts = re.split(r"(?<=\S) (?=\S)", text)
            return (self.cuts[cuts[0]] if after_space and not cuts[0][:1].isspace() else self.in_pre_tokens(" " * after_space + cuts[0])) + sum(map(self.cuts.__getitem__, cuts[1:]))
        cuts = text.split(" ")
        return (0 if after_space else self.in_pre_tokens(cuts[0])) + sum(map(self.cuts.__getitem__, cuts if after_space else cuts[1:]))

    def in_text(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        total, begin, at = 0, 0, PIECE
        while 0 <= (at := text.find(" ", at)) < len(text) - 1:
            if text[at - 1].isspace() or text[at + 1].isspace():
                at += 1
                continue
            total += self.in_piece(text[begin:at], begin > 0)
            begin, at = at + 1, at + PIECE
        return total + self.in_piece(text[begin:], begin > 0) if text else 0

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.in_text(text)
        total, begin = 0, 0
        for m in self.added.finditer(text):
            total += self.in_text(text[begin : m.start()]) + 1
            begin = m.end()
        return total + self.in_text(text[begin:])


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of each row of docs(doc_id, text).

    n_tokens is the number of ids that the `tokenizers` library gives for the whole text without adding special tokens; the
    string of an added token in a text is one token, as is the library's default. Null text is empty text: no bytes, no
    tokens. Rows with a null or repeated doc_id have a row each, an empty table gives none, further columns are left out.
    A text of any length is counted whole; memory grows with its longest run that tokens may join throughout.
    """
    path = tokenizer or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = [own.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(lambda batches: common.released(run(batches)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
