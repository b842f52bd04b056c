"""Turtle by its grammar, and files that are split anywhere."""

import random

import pytest

from lattica.sources import turtle
from lattica.sources.turtle import Parser, TurtleError

X = "http://www.w3.org/2001/XMLSchema#"
R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def triples(text, base=""):
    return [(s, p, o) for s, p, o, _ in Parser("m", {}, base).load(text, "0").parse()]


@pytest.mark.parametrize(("text", "want"), [
    ("@prefix : <u:> . :a a :b .", [("<u:a>", f"<{R}type>", "<u:b>")]),
    ("@prefix x: <u:> . x:a x:p 1 , -2.5 , 1e3 , 1.E3 , .5 , true ; ; x:q \"s\"@en-GB , 's'^^x:t ; .", [("<u:a>", "<u:p>", f'"1"^^<{X}integer>'), ("<u:a>", "<u:p>", f'"-2.5"^^<{X}decimal>'), ("<u:a>", "<u:p>", f'"1e3"^^<{X}double>'), ("<u:a>", "<u:p>", f'"1.E3"^^<{X}double>'), ("<u:a>", "<u:p>", f'".5"^^<{X}decimal>'), ("<u:a>", "<u:p>", f'"true"^^<{X}boolean>'), ("<u:a>", "<u:q>", '"s"@en-GB'), ("<u:a>", "<u:q>", '"s"^^<u:t>')]),
    ('<a> <b> """x "q" \n . <c> # \\""" \\u00e9""" . # <d> .', [("<a>", "<b>", '"x "q" \n . <c> # """ é"')]),
    ("<a> <b> '''it's''' , '' , \"\" , \"a\\tb\\\\\" .", [("<a>", "<b>", '"it\'s"'), ("<a>", "<b>", '""'), ("<a>", "<b>", '""'), ("<a>", "<b>", '"a\tb\\"')]),
    ("@prefix x: <u:> . x:a.b x:c\\,d%20 x:, <e#f> .", [("<u:a.b>", "<u:c,d%20>", "<u:>"), ("<u:a.b>", "<u:c,d%20>", "<e#f>")]),
    ("@base <http://h/a/b?q> . <c> <../d> <#e> . <?x> </y> <//z/w> . @base <f/> . <> <g> <http://k/./l/../m> .", [("<http://h/a/c>", "<http://h/d>", "<http://h/a/b?q#e>"), ("<http://h/a/b?x>", "<http://h/y>", "<http://z/w>"), ("<http://h/a/f/>", "<http://h/a/f/g>", "<http://k/./l/../m>")]),
    ('<a> <b> "x"^^<' + X + 'string> . <é> <\\u00e9> <\\U0001F600> .', [("<a>", "<b>", '"x"'), ("<é>", "<é>", "<\U0001f600>")]),
    ("", []), ("# only", []),
])
def test_statements(text, want):
    assert triples(text) == want


def test_dots_and_characters_of_names():
    with pytest.raises(TurtleError):  # a dot within a name belongs to it
        triples("PREFIX x: <u:>\nprefix y: <v:> x:a y:b x:c.y:d x:e 'f' .")
    assert triples("PREFIX x: <u:>\nprefix y: <v:> x:a y:b x:c. y:d x:e 'f' .") == [("<u:a>", "<v:b>", "<u:c>"), ("<v:d>", "<u:e>", '"f"')]
    head = "@prefix été: <u:> . @prefix a.b: <v:> . "
    assert triples(head + "été:ñ·1 a.b:0 a.b: .") == [("<u:ñ·1>", "<v:0>", "<v:>")]
    with pytest.raises(TurtleError):  # a name may begin with a digit, but not with a minus
        triples(head + "été:ñ·1 a.b:0 a.b:-1 .")


def test_nested_nodes_and_lists():
    got = triples("_:a.b <p> [ <q> [] ; <r> ( 1 _:c ) ] . [ <s> () ] .")
    assert len(got) == 8 and ("_:m.a.b", "<p>") in {t[:2] for t in got}
    firsts = {s: o for s, p, o in got if p == f"<{R}first>"}
    rests = {s: o for s, p, o in got if p == f"<{R}rest>"}
    node = next(o for _, p, o in got if p == "<r>")
    assert firsts[node] == f'"1"^^<{X}integer>' and firsts[rests[node]] == "_:m.c" and rests[rests[node]] == f"<{R}nil>"
    assert next(o for _, p, o in got if p == "<s>") == f"<{R}nil>"


@pytest.mark.parametrize("text", ["<a> <b> .", "<a> <b> <c>", "x:a <b> <c> .", '"a" <b> <c> .', "<a> <b> \"x\ny\" .", "<a> <b> '''x .", "<a b> <c> <d> .", "@prefix x <u:> .", "<a> <b> ( <c> .", "[ <b> <c> . ] .", "<a> _:b <c> .", "[] ."])
def test_errors(text):
    if text == "[] .":  # allowed by the grammar of TriG only; here nothing follows from it
        assert triples(text) == []
        return
    with pytest.raises(TurtleError):
        triples(text)


def test_graphs():
    text = "@prefix : <u:> . { :a :b :c } :g { :a :b :d . :e :f [ :h :i ] . } GRAPH <k> { } :x :y :z ."
    got = Parser("m").load(text, "0").parse(graphs=True)
    assert [(s, o, g) for s, _, o, g in got if not s.startswith("_") and not o.startswith("_")] == [("<u:a>", "<u:c>", None), ("<u:a>", "<u:d>", "<u:g>"), ("<u:x>", "<u:z>", None)]
    assert sum(g == "<u:g>" for *_, g in got) == 3


def written_files(folder):
    """A large file with long strings, directives and statements over many lines; a small one; a broken one; an empty one."""
    rng, out = random.Random(4), ["@prefix : <u:> .\n"]
    for k in range(3000):
        out.append(rng.choice([
            f":a{k} :p :b{k} .\n", f":a{k}\n  :p :b{k} ,\n  :c{k}\n.\n", f':a{k} :t """line one . # no\n@prefix : <no:> .\n \\"""{k}\n\'\'\' ""\n""" .\n', f":a{k} :q '''x\n\"\"\"\n{k}''' ; :r {k}.5 . # .\n",
            f"[ :n {k} ] :m ( :x{k}\n\n {k} ) .\n", f"PREFIX : <u{k % 7}:>\n", f"@base <http://h/{k}/> .\n<r> :s <t>.\n", f":z{k} :l 'a.b' , 'c' . :y{k} :l _:n{k % 5} .\n"]))
    (folder / "large.ttl").write_text("".join(out), encoding="utf-8")
    (folder / "small.ttl").write_text("<a> <b> <c> ;\n <d> _:n0 .", encoding="utf-8")
    (folder / "broken.ttl").write_text("<a> <b> <c> .\n<a> <b .\n<a> <b> <d> .", encoding="utf-8")
    (folder / "empty.ttl").write_text("")
    return "".join(out)


def shape(rows):
    """Rows with made-up blank nodes left unnamed, sorted."""
    plain = lambda x: "_" if x.startswith("_:large.") and not x.startswith("_:large.n") else x
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("size", ["400", "7000", "128m"])
def test_split_files_give_what_whole_ones_give(spark, tmp_path, size, monkeypatch):
    text = written_files(tmp_path)
    want = shape(r[:3] for r in Parser("large").load(text, "0").parse())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if size == "400":  # thousands of blocks: a shorter file does
        text = text[:40_000].rsplit(" .\n", 1)[0] + " .\n"
        while True:
            try:
                want = shape(r[:3] for r in Parser("large").load(text, "0").parse())
                break
            except TurtleError:  # cut within a string
                text = text[: len(text) - 4].rsplit(" .\n", 1)[0] + " .\n"
        (tmp_path / "large.ttl").write_text(text, encoding="utf-8")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        monkeypatch.setattr(turtle, "CHUNK", 900)
        rows = turtle.read_turtle(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert shape((r["s"], r["p"], r["o"]) for r in rows if r["model"] == "large") == want and len(want) > 300
    assert [(r["s"], r["error"] is None) for r in rows if r["model"] == "broken"] == [(None, False)]
    assert sorted(r["o"] for r in rows if r["model"] == "small") == ["<c>", "_:small.n0"]
    made = [r["s"] for r in rows if r["p"] in ("<u:n>", f"<{R}first>")]
    assert len(made) == len(set(made))


def test_chunks_are_given_what_holds_there(spark, tmp_path, monkeypatch):
    """A directive a statement: a chunk is not given all that stand before it, but what these come to; relative ones too."""
    rng, out = random.Random(9), ["@base <http://h/a/b> .\n"]
    for k in range(1500):
        kind = rng.randrange(6) if k % 100 < 50 else 5
        out.append([f"@prefix x: <http://x/{k}#> .\n", f"BASE <http://g/{k}/e>\n", f"prefix y: <r{k}/>\n", "@base <../c/d> .\n", f'@prefix z: <z{k}> . # BASE <no> """\n', ""][kind])
        out.append(f'<s{k}> <base> """prefix x: <no> .\n{k}""" .\n' if k < 100 else f"<s{k}> <p> <#{k}> .\n")
    out.append("x:a y:b z:c .\n")
    (tmp_path / "many.ttl").write_text("".join(out))
    monkeypatch.setattr(turtle, "CHUNK", 300)
    rows = turtle.read_turtle(spark, str(tmp_path)).collect()
    assert sorted((r["s"], r["p"], r["o"]) for r in rows) == sorted(triples("".join(out)))
    held = turtle.holding(turtle.statement_chunks(turtle.read_lines(spark, str(tmp_path)))).collect()
    assert len(held) > 50 and max(len(r["held"]) for r in held) == 4


def test_directives_come_to():
    base, rel = ("base", "", "<http://h/a/>"), ("prefix", "x", "<b#>")
    assert turtle.reduced([rel, base]) == [rel, base]
    assert sorted(turtle.reduced([("prefix", "x", "<u:1>"), base, rel, ("base", "", "<c/>")])) == [("base", "", "<http://h/a/c/>"), ("prefix", "x", "<http://h/a/b#>")]
    assert turtle.reduced([("prefix", "x", r"<u:\u005Cu0041>")]) == [("prefix", "x", r"<u:\u005Cu0041>")]
