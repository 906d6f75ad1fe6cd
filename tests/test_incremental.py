import hashlib

import pytest
from pyspark.sql import functions as F

from folioflow.operators import incremental as I


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_notations(spark):
    h = sha("x")
    import base64

    forms = [h, h.upper(), "sha256:" + h, "SHA-256: " + h.upper(), " " + h + " ", ":".join(h[i : i + 2] for i in range(0, 64, 2)), base64.b64encode(bytes.fromhex(h)).decode(), "0x" + h]
    rows = spark.createDataFrame([(f,) for f in forms] + [("broken",), (None,), ("",)], "h string").select(I.parsed_digest(F.col("h")).alias("d")).collect()
    assert [bytes(r.d) for r in rows[: len(forms)]] == [bytes.fromhex(h)] * len(forms)
    assert bytes(rows[-3].d) == b"broken" and rows[-2].d is None and bytes(rows[-1].d) == b""


def _chunks(spark, rows):
    c = spark.createDataFrame(rows, "doc_id string, chunk_id string, revision int, source string, output string").withColumn("source_hash", F.lit("clash")).drop("source_hash")
    return I.latest(c.select("doc_id", "chunk_id", "revision", I.digest(F.col("source")).alias("s"), I.digest(F.col("output")).alias("o")), ["doc_id", "chunk_id"], ["revision"], ["s", "o"])


def test_pending(spark):
    now = _chunks(spark, [("a", "1", 2, "new", "x"), ("a", "1", 1, "old", "x"), ("a", "1", 2, "new", "x"), ("a", "2", 1, "s", None), ("a", "3", 1, "s", "o"), ("a", "4", 1, "s", "o"), (None, "9", 1, "s", "o")])
    then = spark.createDataFrame([("a", "1", sha("old"), sha("x")), ("a", "2", sha("s"), None), ("a", "3", sha("s").upper(), "sha256:" + sha("o")), ("z", "1", sha("s"), None)], "doc_id string, chunk_id string, s string, o string")
    then = then.select("doc_id", "chunk_id", I.parsed_digest(F.col("s")).alias("s"), I.parsed_digest(F.col("o")).alias("o"))
    assert sorted(r.chunk_id for r in I.pending(now, then, ["doc_id", "chunk_id"], ["s", "o"]).collect()) == ["1", "4"]
    acts = {(r.doc_id, r.chunk_id): r.action for r in I.plan_changes(now, then, ["doc_id", "chunk_id"], ["s", "o"]).collect()}
    assert acts == {("a", "1"): "changed", ("a", "2"): "same", ("a", "3"): "same", ("a", "4"): "new", ("z", "1"): "gone"}
    assert I.pending(now.limit(0), then, ["doc_id", "chunk_id"], ["s", "o"]).count() == 0 and I.pending(now, then.limit(0), ["doc_id", "chunk_id"], ["s", "o"]).count() == 4


def test_runs_survive_failures(spark, tmp_path):
    inc = I.Increment(spark, f"file://{tmp_path}/state", ["k"], ["h"])
    v1 = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, h string")
    v2 = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "k string, h string")
    seen = lambda: sorted((r.k, r.h) for r in inc.output().collect()) if inc.output() is not None else []
    for where in ("output", "manifest", "claim"):
        with pytest.raises(Dies):
            Dying(where, inc).run(v1, lambda d: d)
        assert seen() == []
    assert inc.run(v1, lambda d: d) and seen() == [("a", "1"), ("b", "1")]
    assert inc.run(v1, lambda d: d) is None
    with pytest.raises(Dies):
        Dying("claim", inc).run(v2, lambda d: d)
    assert inc.run(v2, lambda d: d) and seen() == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
    assert inc.run(v2, lambda d: d) is None
    assert sorted((r.k, r.h) for r in inc.current().collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    inc.fold()
    assert inc.run(v2, lambda d: d) is None and inc.current().count() == 3
    v3 = spark.createDataFrame([("a", "9")], "k string, h string")
    with pytest.raises(Dies):  # dead behind its claim: the next run carries it through
        Dying("rename", inc).run(v3, lambda d: d)
    assert inc.run(v3, lambda d: d) is None and ("a", "9") in seen()


class Dies(Exception):
    pass


class Dying(I.Increment):
    """Dies at one place of a run."""

    def __init__(self, where, of):
        super().__init__(of.spark, of.root, of.keys, of.digests)
        self.where = where

    def _write(self, rows, to):
        super()._write(rows.limit(1) if self.where == "output" and to.startswith("out/") else rows, to)
        if self.where == "output" and to.startswith("out/") or self.where == "manifest" and to.startswith(".staging/"):
            raise Dies

    def _commit(self, number, batch):
        if self.where == "claim":
            raise Dies
        super()._commit(number, batch)

    def _rename(self, batch):
        if self.where == "rename":
            raise Dies
        super()._rename(batch)


def test_source_that_changes_between_output_and_commit(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    write = lambda h: spark.createDataFrame([("a", h)], "k string, h string").write.mode("overwrite").parquet(src)
    inc = I.Increment(spark, f"file://{tmp_path}/state", ["k"], ["h"])
    now = lambda: spark.read.schema("k string, h string").parquet(src)
    write("1")

    def process(work):
        rows = work.collect()
        write("2")  # the record changes while it is worked
        return spark.createDataFrame(rows, work.schema)

    assert inc.run(now(), process)
    assert inc.manifest(now()).collect() == [("a", "1")] and [(r.k, r.h) for r in inc.current().collect()] == [("a", "1")]
    assert inc.run(now(), lambda d: d) and [(r.k, r.h) for r in inc.current().collect()] == [("a", "2")]


def test_two_runs_at_once(spark, tmp_path):
    inc = I.Increment(spark, f"file://{tmp_path}/state", ["k"], ["h"])
    v1, v2 = (spark.createDataFrame([("a", h)], "k string, h string") for h in "12")

    def process(work):
        assert inc.run(v2, lambda d: d)
        return work

    with pytest.raises(I.Conflict):
        inc.run(v1, process)
    assert inc.manifest(v1).collect() == [("a", "2")]


def test_only_files_that_differ_are_read(spark, tmp_path):
    for name, text in (("a.md", "x"), ("b.md", "y")):
        (tmp_path / name).write_text(text)
    first = I.file_listing(spark, str(tmp_path), "*.md")
    known = spark.createDataFrame([(r.path, r.size, r.modified, "kept" if r.path.endswith("a.md") else r.checksum) for r in first.collect()], first.schema)
    (tmp_path / "b.md").write_text("yy")
    (tmp_path / "c.md").write_text("z")
    got = {r.path[-4:]: (r.size, r.checksum) for r in I.file_listing(spark, str(tmp_path), "*.md", known).collect()}
    assert got == {"a.md": (1, "kept"), "b.md": (2, sha("yy")), "c.md": (1, sha("z"))}
    read = I.file_stats(spark, str(tmp_path), "*.md")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "length" in read and "content" not in read


def test_file_listing(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    rows = I.file_listing(spark, str(tmp_path), "*.md").collect()
    assert [(r.size, r.checksum) for r in rows] == [(1, sha("x"))]
