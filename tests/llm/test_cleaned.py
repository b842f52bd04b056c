"""Removed lines are gone from the text that a stage writes; the number of distinct documents of a host decides."""

from lattica.llm import common, lines

SCHEMA = "doc_id long, text string, source string, n_chars long"


def corpus(spark):
    body = lambda k: " ".join(f"u{k}x{j}" for j in range(60))
    rows = [(k, f"Menu  home\n{body(k)}\nMENU home\n" if k < 60 else body(k), "big") for k in range(400)]
    rows += [(500, "menu home\n" * 40 + "left over words", "big"), (501, None, "big")]
    return spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], SCHEMA), body


def test_lines_above_the_limit_are_removed(spark):
    docs, _ = corpus(spark)
    removed = lambda **k: sum(r["removed_words"] for r in lines.judge(docs, **k).collect())
    # 61 distinct documents of the host have the line.
    assert removed() == removed(line_documents=60) == 60 * 4 + 80 and removed(line_documents=61) == 0


def test_text_is_less_the_removed_lines(spark):
    docs, body = corpus(spark)
    got = {r["doc_id"]: r for r in lines.cleaned(common.numbered(docs)).collect()}
    assert set(got) == set(range(400))
    for k, r in got.items():
        want = f"{body(k)}\n" if k < 60 else body(k)
        assert (r["text"], r["n_chars"], r["source"]) == (want, len(want), "big")


def test_near_copies_do_not_count(spark):
    """40 near copies, each with one of ten lines changed, and pages with a menu: without copies only the menu is boilerplate."""
    line = lambda k: " ".join(f"v{k}y{j}" for j in range(12))
    copy = lambda k: "\n".join(f"{line(i)} edit{k}" if i == k % 10 else line(i) for i in range(10))
    pages = [(k, "Menu  home\n" + " ".join(f"u{k}x{j}" for j in range(60)), "big") for k in range(20)]
    rows = pages + [(100 + k, copy(k), "big") for k in range(40)] + [(200, "menu HOME\n" * 40 + " ".join(f"z{j}" for j in range(20)), "big")]
    docs = spark.createDataFrame([(d, t, s, len(t)) for d, t, s in rows], SCHEMA)
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in lines.judge(docs, copies=False).collect()}
    assert got == {k: (2, True) for k in range(20)} | {100 + k: (0, True) for k in range(40)} | {200: (80, False)}
    plain = {r["doc_id"]: r["kept"] for r in lines.judge(docs).collect()}
    assert not any(plain[100 + k] for k in range(40)) and all(plain[k] for k in range(20)) and not plain[200]
    texts = {r["doc_id"]: r["text"] for r in lines.cleaned(common.numbered(docs), copies=False).collect()}
    assert texts == {d: t.split("\n", 1)[1] if d < 20 else t for d, t, _ in rows if d != 200}
