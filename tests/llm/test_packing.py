"""Vector best-fit against the sequential algorithm, under capacities that bind; ids of wide vocabularies."""

from array import array
from collections import Counter

import numpy as np
import pytest

from lattica.llm import packing, tokens


def sequential(histogram, full, rule, weights):
    """Piece by piece: (length, rank) to (sequence, offset)."""
    full, bins, out = np.array(full), [], {}
    for n in sorted(histogram, reverse=True):
        demand = np.array([n, 1, n * n])
        for r in range(histogram[n]):
            fits = [k for k, left in enumerate(bins) if (left >= demand).all()]
            if fits:
                score = packing.scores(np.array([bins[k] for k in fits]), demand, full, np.array(weights), rule)
                k = min(zip(score, fits))[1]
            else:
                bins.append(full.copy())
                k = len(bins) - 1
            out[n, r] = k, int(full[0] - bins[k][0])
            bins[k] = bins[k] - demand
    return out, bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("full", [(32, 32, 1024), (32, 3, 1024), (32, 32, 1030), (48, 6, 1100)])
def test_plan_is_the_sequential_packing(rule, full):
    bound = Counter()
    for seed in range(12):
        h = Counter(np.random.default_rng(seed).integers(1, 33, 250).tolist())
        for weights in ((1.0, 0.01, 0.01), (1.0, 1.0, 1.0)):
            want, bins = sequential(h, full, rule, weights)
            runs, opened = packing.vector_best_fit(h, *full, rule, weights)
            got = {(n, rank + j): (first + j // each, at + j % each * n) for n, rank, c, first, each, at in runs for j in range(c)}
            assert got == want and opened == len(bins)
            bound.update(k for left in bins for k in range(3) if left[0] > 0 and (left - np.array([1, 1, 1]) < 0)[k])
    if full[1] == 3:
        assert bound[1] > 0  # sequences full by their pieces alone


def test_attention_binds():
    runs, opened = packing.vector_best_fit({10: 8, 1: 40}, 48, 48, 210)
    held = Counter()
    for n, _, c, first, each, _ in runs:
        held.update((first + j // each, n) for j in range(c))
    assert opened == 4 and all(held[k, 10] == 2 and held[k, 1] == 10 for k in range(4))


def test_rules_look_for_other_room():
    """norm fills the fullest sequence that fits; dot the one whose room is of the piece's kind: many pieces, few tokens."""
    full, demand, w = np.array([100, 10, 10_000]), np.array([2, 1, 4]), np.ones(3)
    left = np.array([[10, 2, 9000], [90, 9, 9990], [30, 10, 100]])
    assert packing.scores(left, demand, full, w, "norm").argmin() == 0 and packing.scores(left, demand, full, w, "dot").argmin() == 2
    with pytest.raises(ValueError):
        packing.vector_best_fit({5: 1}, 8, 8, 24)


def test_wide_vocabularies(spark, tmp_path):
    """70,000 words: ids need 32 bits, and the library encodes, as the file is no byte-level BPE."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_000)}, unk_token="w0"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "words.json")
    t.save(path)
    docs = spark.createDataFrame([(1, "w69999 w65536 w5"), (2, None), (3, "w1 " * 20)], "doc_id long, text string")
    (m,) = packing.packed_matrices(docs, path, capacity=8, rows=64).collect()
    got = sorted(packing.unpacked(m, 8))
    assert tokens.id_bytes(path) == m["id_bytes"] == 4 and got[0] == (1, 0, [69_999, 65_536, 5, 2]) and got[1] == (2, 0, [2])
    assert sum(len(ids) for d, _, ids in got if d == 3) == 21 and {r["length"] for r in packing.vector_pack(docs, path, 8).collect()} == {4, 1, 5, 8}


def test_words_need_no_pre_tokeniser(monkeypatch):
    """Cuts of letters alone have the library's ids without it; other scripts, digits and marks are still split by it."""
    enc = tokens.Encoder(tokens.default_path())
    words = ["the", "Straße", "être", "ªµº", "Dž", "ZZqqxyv", "a" * 300, "naïve", "l", "ɏ"]
    others = ["слово", "語", "x1", "can't", "a-b", "é", "ʰ", "don't.", "x\ny", "ǅ,", "Ⅷ", "²"]
    want = {w: array("I", enc.library.encode(" " + w, add_special_tokens=False).ids).tobytes() for w in words + others}
    assert {w: enc.seen[w] for w in words + others} == want
    asked = []
    monkeypatch.setattr(enc.seen, "encode", lambda text: asked.append(text) or b"")
    enc.seen.clear()
    assert [enc.seen[w] for w in words] == [want[w] for w in words] and not asked
    assert enc.encode("a b " + " ".join(words)) and enc.seen["слово"] == b"" and asked == [" слово"]
