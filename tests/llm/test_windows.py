"""Licences wrapped over lines inside long documents, and inside longer lines, against all windows by brute force."""

import random
import textwrap
import time

import pytest

from lattica.llm import licenses


def test_wrapped_notices(spark):
    prose = lambda k: " ".join(f"v{k}x{j}" for j in range(400))
    names = ["Apache-2.0-notice", "MIT-license", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-notice", "MPL-2.0", "ISC", "AGPL-3.0-notice", "LGPL-2.1-notice", "EPL-2.0", "Unlicense", "CC0-1.0"]
    rows = [(k, f"{prose(k)}\n# " + "\n# ".join(textwrap.wrap(licenses.TEMPLATES[n], 75)) + f"\n{prose(-k)}") for k, n in enumerate(names)]
    rows += [(90, f"{prose(1)} {licenses.TEMPLATES['MIT']} {prose(2)}"), (91, prose(3)), (92, "permission notice " * 9000)]
    got = {r["doc_id"]: (r["license"], r["line"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The Apache notice begins with the short one: of equal coefficients the first name counts.
    assert got == {**{k: (n, 1) for k, n in enumerate(names)}, 0: ("Apache-2.0", 1), 90: ("MIT", 0), 91: (None, None), 92: (None, None)}


@pytest.mark.parametrize("text", ["x a b c d e f y", "a b a b q c d e f g a b", "a b c z d e f g", "a b c d a b c d e", "q q q"])
def test_windows_are_the_best(text):
    m = licenses.Matcher({"t": "a b c d e f g", "u": "c d e f"}, 0.6)
    w = text.split()
    best = max(licenses.dice(set(zip(w[i:j], w[i + 1 : j])), b) for i in range(len(w)) for j in range(i + 2, len(w) + 1) for _, b in m.of)
    assert ((m.window(text) or (0,))[0]) == (best if best >= 0.6 else 0)


def by_all_windows(matcher, words):
    """The best coefficient of all windows, and the first line's word at which a window of it begins, by brute force."""
    return max((licenses.dice(set(zip(words[i:j], words[i + 1 : j])), b) for i in range(len(words)) for j in range(i + 2, len(words) + 1) for _, b in matcher.of), default=0)


def test_windows_of_texts_that_repeat_themselves():
    rng = random.Random(9)
    m = licenses.Matcher({"t": "a b c d e f g", "u": "c d e f", "v": "a b a c a d b"}, 0.55)
    for _ in range(400):
        piece = [rng.choice("abcdefgxy") for _ in range(rng.randint(1, 7))]
        words = (piece * rng.randint(1, 5) + [rng.choice("abcdefgq") for _ in range(rng.randint(0, 8))] + piece * rng.randint(0, 2))[:32]
        best = by_all_windows(m, words)
        assert (m.window(" ".join(words)) or (0,))[0] == (best if best >= 0.55 else 0), words


@pytest.mark.parametrize("fragment", ["permission is hereby granted free of charge to any person obtaining a copy ", "redistributions of source code must retain the above copyright notice x y ", "the software "])
def test_a_million_repeated_words_take_seconds(fragment):
    m = licenses.Matcher(licenses.TEMPLATES, 0.8)
    words = len(fragment.split())
    head = " ".join(licenses.TEMPLATES["BSD-2-Clause"].split()[:70])
    for text in (fragment * (1_000_000 // words), head + " " + fragment * (300_000 // words)):
        began = time.time()
        m.window(text)
        assert time.time() - began < 60
