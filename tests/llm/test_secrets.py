import hashlib
import re
from collections import Counter

import duckdb

from rillstore.llm import secrets
from rillstore.llm.catalog import ORACLE_SQL, op1_secret_ownership

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def of(spans):
    return [(s.start, s.rank, s.end) for s in spans]


def test_base_spans_equal_brute_force(hard, documents):
    for df in (hard, documents):
        texts = df.select("doc_id", "text").collect()
        got = secrets.scan(df, ["doc_id", "text"]).collect()
        assert len(got) == len(texts)
        assert Counter((r.doc_id, r.text, tuple(of(r.base))) for r in got) == Counter((r.doc_id, r.text, tuple(brute(r.text))) for r in texts)
        for r in got:
            assert set(of(r.base)) <= set(of(r.spans)) and of(r.spans) == sorted(of(r.spans))


def test_query_columns(spark, sf_dir):
    got = {r.doc_id: r for r in op1_secret_ownership(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[r.doc_id].n_hex == want.count("hex")


def test_ownership_separates_copied_from_owned(hard):
    got = {r.doc_id: r for r in secrets.scan(hard, ["doc_id"]).collect() if r.doc_id in (9, 10)}
    assert [s.value for s in got[9].spans] == ["K9xkZp03LmQwR7tYvB2nXc81"]  # one owner
    assert (got[9].n_owned, got[9].n_copied) == (1, 1)
    assert got[10].spans == [] and got[10].n_copied == 1  # two owners


def test_repositories_count_too(spark):
    """A token in many repositories of one owner is an example, one in few is owned."""
    rows = [(i, "key K9xkZp03LmQwR7tYvB2nXc81", f"org/repo{i}") for i in range(secrets.MAX_REPOS + 1)] + [(100 + i, "key A9xkZp03LmQwR7tYvB2nXc99", f"org/repo{i}") for i in range(secrets.MAX_REPOS)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    assert {r.doc_id < 100: (r.n_owned, r.n_copied, len(r.spans), r.most_owners, r.most_repos) for r in got} == {True: (0, 1, 0, 1, secrets.MAX_REPOS + 1), False: (1, 0, 1, 1, secrets.MAX_REPOS)}


def test_clashing_and_odd_names(spark):
    docs = spark.createDataFrame([(1, "secret = abcdef1", "o/r", 3, "b", 7)], "doc_id long, text string, source string, `a.b` int, base string, kept int")
    got = secrets.scan(docs, ["doc_id", "a.b", "base", "kept"])
    assert got.columns == ["doc_id", "a.b", "kept_base", "kept", *secrets.RESULTS] and got.first()["kept_base"] == "b"
    left = secrets.redact(docs)
    assert left.columns == docs.columns and left.first().text == "[secret]" and left.first()["a.b"] == 3


def test_redact_keeps_rows_and_columns(hard):
    got = secrets.redact(hard)
    assert got.columns == hard.columns and got.count() == hard.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[4].text == "éé\U0001f600 [secret] AKIASHORT [secret] apikey: 'x1' [secret]\n\n tail"
    assert rows[4].n_chars == len(rows[4].text) and rows[2].text is None and rows[1].text == ""
    assert "0123456789abcdef" not in rows[3].text


def test_empty_table(empty):
    assert secrets.scan(empty, ["doc_id"]).count() == 0
    assert secrets.redact(empty).count() == 0


def test_equals_sql(spark, hard, documents, tmp_path):
    for n, df in enumerate((hard, documents)):
        df.select("doc_id", "text", "source").write.parquet(f"file://{tmp_path}/{n}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{n}/documents.parquet/*.parquet')")
        want = con.execute(ORACLE_SQL["op1_secret_ownership"])
        columns = [c[0] for c in want.description]
        got = op1_secret_ownership(spark, f"file://{tmp_path}/{n}")
        assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
