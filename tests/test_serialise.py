"""Every format gives back what was written, whatever the terms hold and however long a run is."""

import pytest

from lattica.sources import serialise
from lattica.sources.turtle import read_turtle

X = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PREFIXES = {"": "urn:x:", "y": "urn:x:y/", "xsd": X}


def quads():
    rows = [("<urn:x:hot>", f"<urn:x:p{k % 3}>", f"<urn:x:y/{k}>", None) for k in range(300)]
    rows += [("<urn:x:a>", f"<{RDF}type>", "<urn:x:T>", g) for g in (None, "<urn:g>", "_:g")] + [("<urn:x:a>", f"<{RDF}type>", "_:t", None)] * 3
    values = ["", "a", 'q"q', "back\\slash", "line\nend\r\ttab", "é 東 🙂", "<&>]]>", "1", "x@en", '"', "#", '"""']
    rows += [("_:b0", "<urn:x:v>", f'"{v}"{tail}', "<urn:g>") for v in values for tail in ("", "@en-GB", f"^^<{X}integer>", f"^^<{X}boolean>", "^^<urn:x:t>")]
    rows += [("<urn:x:a b>", "<urn:x:y/c/d>", "<http://h/?q=1&r#é>", "<urn:x:g2>"), ("_:b 1", "<urn:x:-no>", "_:b 2", None), ("_:x_1", "<urn:x:>", '"true"^^<' + X + "boolean>", None), ("<urn:x:a>", "<urn:x:n>", f'"-7"^^<{X}integer>', None)]
    return rows


def scoped(term, scope):
    return term and (f"_:{scope}.{serialise.label(term)}" if term.startswith("_:") else term)


@pytest.mark.parametrize("run", [7, 1000])
@pytest.mark.parametrize("format", ["turtle", "trig", "trix", "jsonld", "nquads"])
def test_round_trip(spark, tmp_path, monkeypatch, format, run):
    monkeypatch.setattr(serialise, "RUN", run)
    rows = [r for r in quads() if format != "turtle" or r[3] is None]
    df = spark.createDataFrame(rows, "s string, p string, o string, g string")
    serialise.write_graph(df, str(tmp_path / "out"), format, PREFIXES)
    if format == "turtle":
        got = read_turtle(spark, str(tmp_path / "out"), scope="all").selectExpr("s", "p", "o", "cast(null as string) as g", "error").collect()
    else:
        got = serialise.read_graph(spark, str(tmp_path / "out"), format, scope="all").collect()
    assert not [r["error"] for r in got if r["error"]]
    want = sorted({tuple(scoped(t, "all") for t in r) for r in rows}, key=repr)
    assert sorted(((r["s"], r["p"], r["o"], r["g"]) for r in got), key=repr) == want


def test_folded_text():
    rows = [(None, "<urn:x:a>", f"<{RDF}type>", "<urn:x:T>"), (None, "<urn:x:a>", "<urn:x:p>", '"5"^^<' + X + "integer>"), (None, "<urn:x:a>", "<urn:x:p>", "<urn:x:y/b>"), ("<urn:g>", "<urn:x:c>", "<urn:x:p>", '"v"@en')]
    assert list(serialise.trig(iter(rows), {"": "urn:x:", "y": "urn:x:y/"})) == ["@prefix : <urn:x:> .", "@prefix y: <urn:x:y/> .", ":a a :T ;\n    :p 5, y:b .", "<urn:g> {", '  :c :p "v"@en .', "}"]


def test_what_cannot_be_written_or_read(spark, tmp_path):
    with pytest.raises(ValueError, match="named graphs"):
        list(serialise.turtle(iter([("<g>", "<a>", "<b>", "<c>")]), {}))
    with pytest.raises(ValueError, match="XML"):
        list(serialise.trix(iter([(None, "<a>", "<b>", '"\x01"')]), {}))
    for format, text in (("trig", "<g> { <a> <b> }"), ("trix", "<TriX><graph>"), ("jsonld", '[{"@id": "a", "b": [{"@value": 1}]}]'), ("nquads", "<a> <b> .")):
        (tmp_path / format).write_text(text)
        got = serialise.read_graph(spark, str(tmp_path / format), format).collect()
        assert len(got) == 1 and got[0]["s"] is None and got[0]["error"]
    empty = spark.createDataFrame([], "s string, p string, o string")
    assert serialise.documents(empty, "trig").collect() == []
