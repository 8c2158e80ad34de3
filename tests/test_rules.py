"""Rules of the search layer, the graph and the readers that no query of the tables can show."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import checks, chunker, graph, incremental, lexical
from quarry.sources import metadata

DOCS = "doc_id string, doc_num int, title string, keywords array<string>, status string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("D1", 1, "Internet Protocol", ["routing"], "current"), ("D2", 2, "Mail Transfer", ["smtp", "protocol"], "current"), ("D3", 3, "Old Mail", None, "obsoleted")], DOCS)


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([("stream", "ietf", "D1"), ("stream", "ietf", "D3"), ("level", "std", "D1"), ("level", "info", "D2")], "tag_type string, tag_name string, doc_id string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_words_that_do_not_count_restrict_nothing(docs):
    known = {1, 2, 3}.__contains__
    assert ids(lexical.search(docs, [], known)) == ["D1", "D2", "D3"]
    assert ids(lexical.search(docs, ["ip", "of"], known)) == ["D1", "D2", "D3"]
    assert ids(lexical.search(docs, ["of", "mail"], known)) == ["D2", "D3"]
    assert ids(lexical.search(docs, ["ip"], known)) == []
    assert ids(lexical.search(docs, ["protocol"], known)) == ["D1", "D2"]  # by title, by keyword only
    assert ids(lexical.search(docs, ["mail", "2"], known)) == ["D2"]
    assert ids(lexical.search(docs, ["2", "internet"], known)) == []


def test_a_request_without_words_lists_the_tagged(docs, tags):
    known = {1, 2, 3}.__contains__
    ask = lambda **k: ids(lexical.answer(docs, tags, lexical.Request(**k), known))
    assert ask() == [] and ask(words=["ma"]) == []
    assert ask(tags={"stream": "ietf"}) == ["D1"] and ask(tags={"stream": "ietf"}, obsolete=True) == ["D1", "D3"]
    assert ask(tags={"stream": "ietf", "level": "std"}) == ["D1"] and ask(tags={"level": "info"}, words=["smt"]) == ["D2"]
    with pytest.raises(KeyError, match="nobody"):
        ask(tags={"stream": "nobody"})


def test_chains_without_bound(spark):
    n = 200
    docs = spark.createDataFrame([(i,) for i in range(n + 1)], "doc_id long")
    old = spark.createDataFrame([(i, i + 1) for i in range(n)], "doc_id long, old long")
    edges = spark.createDataFrame([(1000 + i, i, i % 2 == 0) for i in range(n + 1)], "src long, dst long, normative boolean")
    assert {r.doc_id: r.refs for r in graph.inherited_counts(docs, edges, old).collect()} == {i: n + 1 - i for i in range(n + 1)}
    listed = graph.inherited_list(docs.where("doc_id = 0"), edges, old)
    assert listed.count() == 1  # its old ones aren't documents of that table, so they lead no further
    whole = graph.inherited_list(docs, edges, old).where("doc_id in (0, 150)").orderBy("doc_id", "place").collect()
    assert [(r.of, r.depth) for r in whole] == [(i, i) for i in range(n + 1)] + [(i, i - 150) for i in range(150, n + 1)]


def test_diamonds_count_by_path_and_cycles_are_refused(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    old = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 9)], "doc_id long, old long")
    edges = spark.createDataFrame([(100 + k, d, True) for d, k in [(1, 0), (2, 0), (2, 1), (3, 0), (4, 0), (4, 1), (9, 7)]], "src long, dst long, normative boolean")
    assert {r.doc_id: r.refs for r in graph.inherited_counts(docs, edges, old).collect()} == {1: 1 + 2 + 1 + 2 * 2, 2: 2 + 2, 3: 1 + 2, 4: 2, 5: 0}
    got = graph.inherited_list(docs, edges, old).where("doc_id = 1").orderBy("place").collect()
    assert [(r.of, r.src) for r in got] == [(1, 100), (2, 100), (2, 101), (4, 100), (4, 101), (3, 100), (4, 100), (4, 101)]
    round_ = old.union(spark.createDataFrame([(4, 1)], "doc_id long, old long"))
    for f in (graph.inherited_counts, graph.inherited_list):
        with pytest.raises(graph.Cycle):
            f(docs, edges, round_).count()
    assert graph.inherited_counts(docs, edges, old.limit(0)).count() == 5


def test_front_matter_is_found_on_any_first_line():
    assert chunker.masthead("Network Working Group  J. Postel\nmore") and chunker.masthead("J. Doe                Example Inc\nCategory: Informational\nx")
    assert chunker.masthead("Updates: 12\nISSN: 2070-1721") and chunker.masthead("RFC 1234      A Title of Something     May 1998\nand text")
    assert not chunker.masthead("The Category: is explained here, with no line of its own") and not chunker.masthead("RFC 1234 says so")


@pytest.mark.parametrize("content,rows", [('[{"a": 1, "b": "x"}, {"a": 2}]', [(1, "x"), (2, None)]), (' {"a": 3, "b": "y"}\n', [(3, "y")]), ("[]", []), ('[{"a": 1', None), ("no json", None), ('{"a": 1} {', None)])
def test_json_tables_that_cannot_be_read_are_said_to_have_failed(spark, tmp_path, content, rows):
    (tmp_path / "t.json").write_text(content)
    got, failed = metadata.read_json(spark, str(tmp_path / "t.json"), "a int, b string")
    assert failed == (rows is None) and [tuple(r) for r in got.orderBy("a").collect()] == (rows or [])
    assert got.columns == ["a", "b"]


def test_a_missing_json_table_has_failed(spark, tmp_path):
    got, failed = metadata.read_json(spark, str(tmp_path / "none.json"), "a int, b array<string>")
    assert failed and got.count() == 0 and got.select(F.size("b")).columns


def test_fingerprints_follow_the_code_and_not_its_looks():
    a = incremental.fingerprint('def f(x):\n    """Says."""\n    return x + 1  # one\n', {"cap": 1})
    assert a == incremental.fingerprint("def f(x):\n\n    return (x + 1)\n", {"cap": 1})
    assert incremental.reuse_forbidden(a, incremental.fingerprint("def f(x):\n    return x + 2\n", {"cap": 1})) == "changed: code"
    assert incremental.reuse_forbidden(a, {**a, "opts": "{}"}) == "changed: opts" and incremental.reuse_forbidden(a, dict(a)) is None
    assert incremental.fingerprint("not  python ::", {})["code"] == incremental.fingerprint("not python\n::", {})["code"]


def test_tag_files_are_written_where_they_change(spark, tmp_path):
    (tmp_path / "a").write_text("RFC1 One\nname A\n")
    lines = spark.createDataFrame([("a", 0, "RFC1 One"), ("a", 1, "name A"), ("b", 0, "RFC2 Two")], "file string, line_no int, line string")
    before = (tmp_path / "a").stat().st_mtime_ns
    assert metadata.write_tag_files(lines, str(tmp_path)) == ["b"]
    assert (tmp_path / "a").stat().st_mtime_ns == before and (tmp_path / "b").read_text() == "RFC2 Two\n"


def test_attributes_with_a_default(spark):
    df = spark.createDataFrame([({"a": 1}, "a"), ({"a": 1}, "b"), ({"b": None}, "b"), (None, "a"), ({"a": 2}, None)], "m map<string,int>, k string")
    assert [r[0] for r in df.select(text.attribute(F.col("m"), F.col("k"), F.lit(9))).collect()] == [1, 9, 9, 9, 9]


def test_agreement_on_a_sample(spark):
    owner = spark.range(1000).select("id", F.lit(1).alias("cluster_id"))
    other = spark.range(1000).select("id", F.when(F.col("id") == 5, 2).otherwise(1).alias("cluster_id"))
    whole, part = checks.agreement(owner, other).first(), checks.agreement(owner, other, sample=0.2).first()
    assert (whole.checked, whole.equal) == (1000, 999) and 120 < part.checked < 280 and part.equal >= part.checked - 1
