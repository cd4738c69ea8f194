"""Published versions, unique keys and stateful ingest: also when a job is killed midway."""

import pytest
from pyspark.sql import functions as F

from annoweave.operators import maintenance
from annoweave.sources.versions import Versions
from annoweave.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_whole_whenever_a_job_dies(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    table, other = Versions(spark, path), Versions(spark, path)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    first = table.publish(spark.createDataFrame([("a", 1)], "k string, v int"))
    assert rows(other.read()) == [("a", 1)]

    def add(old):
        return old.unionByName(spark.createDataFrame([("b", 2)], "k string, v int"))

    with monkeypatch.context() as m:  # dies before the switch, the new files written
        m.setattr(type(table.pointer), "set", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.update(add)
    assert rows(other.read()) == rows(Versions(spark, path).read()) == [("a", 1)]
    with pytest.raises(Exception, match="boom"):  # dies while writing
        table.update(lambda old: old.withColumn("v", F.when(F.rand() < 2, F.raise_error(F.lit("boom"))).cast("int")))
    assert rows(other.read()) == [("a", 1)]
    table.update(add)  # dies after the switch: nothing is left to do
    assert rows(other.read()) == rows(Versions(spark, path).read()) == [("a", 1), ("b", 2)]
    assert rows(other.read(first)) == [("a", 1)]
    assert table.drop_others() >= 2
    assert rows(other.read()) == [("a", 1), ("b", 2)]


def test_a_publication_on_an_old_version_is_refused(spark, tmp_path):
    one, two = (Versions(spark, f"{tmp_path}/t") for _ in range(2))
    base = one.publish(spark.range(1))
    two.publish(spark.range(2), base)
    with pytest.raises(ValueError, match="current"):
        one.publish(spark.range(3), base)
    assert one.read().count() == 2


def test_insert_ignore_keeps_the_first_of_repeated_keys(spark):
    schema = "k string, e string, v int"
    old = spark.createDataFrame([("a", None, 1)], schema)
    new = spark.createDataFrame([("a", None, 2), ("b", "x", 5), ("b", "x", 4), ("c", None, 7), ("c", None, 6)], schema)
    assert [tuple(r) for r in maintenance.insert_ignore(old, new, ["k", "e"]).orderBy("k").collect()] == [("a", None, 1), ("b", "x", 4), ("c", None, 6)]
    assert {tuple(r) for r in maintenance.insert_ignore(old, new, ["k", "e"], order=[F.desc("v")]).collect()} == {("a", None, 1), ("b", "x", 5), ("c", None, 7)}
    loose = maintenance.insert_ignore(old, new, ["k", "e"], null_safe=False)
    assert sorted(r.v for r in loose.collect()) == [1, 2, 4, 6, 7]
    assert maintenance.insert_ignore(old.limit(0), new.limit(0), ["k", "e"]).count() == 0


def test_upserts_of_repeated_offers(spark):
    schema = "k string, a string, c int"
    old = spark.createDataFrame([("x", "", 1), ("y", "v", 1)], schema)
    new = spark.createDataFrame([("x", "n", 2, 1), ("x", "m", 3, 2), ("z", "p", 1, 5), ("z", "q", 2, 4)], schema + ", at int")
    for change in (lambda n, **o: maintenance.upsert_fill(old, n, "k", ["a"], ["c"], **o), lambda n, **o: maintenance.upsert_overwrite(old, n, "k", **o)):
        with pytest.raises(ValueError, match="k occurs more than once: x, z"):
            change(new)
        assert rows(change(new, order=["at"])) == [("x", "m", 3, "updated"), ("y", "v", 1, "kept"), ("z", "p", 1, "inserted")]
        assert rows(change(new, order=[F.col("c")])) == [("x", "m", 3, "updated"), ("y", "v", 1, "kept"), ("z", "q", 2, "inserted")]


# -- streams

LINE = "protein string, go_id string, evidence_code string, qualifier string"


def deliver(spark, folder, lines):
    """One file with these lines in order."""
    spark.createDataFrame(lines, LINE).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("P1",), ("P2",)], "accession string"), spark.createDataFrame([("G1",), ("G2",)], "go_id string")


DELIVERIES = [
    [("P1", "G1", "IEA", "b"), ("P1", "G1", "IEA", "a"), ("P2", "G1", None, None), ("P9", "G1", "IEA", None)],
    [("P1", "G1", "IEA", "c"), ("P2", "G1", None, "x"), ("P2", "G2", "IDA", "z"), ("P2", "G2", "IDA", "y")],
    [("P1", "G2", "IMP", None), ("P2", "G9", "IMP", None), ("P2", "G2", "IDA", "q")],
    [("P1", "G2", "IDA", "late")],
]
WANT = sorted([("P1", "G1", "IEA", "b"), ("P2", "G1", None, None), ("P2", "G2", "IDA", "z"), ("P1", "G2", "IMP", None), ("P1", "G2", "IDA", "late")], key=repr)


def ingested(spark, path):
    return sorted([tuple(r) for r in spark.read.parquet(path).select("protein", "go_id", "evidence_code", "qualifier").collect()], key=repr)


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("dies", [0, 1, 2])
def test_a_stream_killed_at_any_batch_gives_the_same_table(spark, tmp_path, known, dies, after):
    """Killed before or after a batch is written, then started again: one row a key, the first line, whole."""
    lines, path, checkpoint = f"{tmp_path}/lines", f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    for d in DELIVERIES:
        deliver(spark, lines, d)
    write = ingest._replace_batch(path)

    def killed(batch, number):
        if number != dies or after:
            write(batch, number)
        if number == dies:
            raise RuntimeError("killed")

    stream = lambda: ingest.file_stream(spark, lines, LINE)
    with pytest.raises(Exception, match="killed"):
        ingest.stream_annotations(stream(), *known, path, checkpoint, sink=killed).awaitTermination()
    ingest.stream_annotations(stream(), *known, path, checkpoint).awaitTermination()
    assert ingested(spark, path) == WANT
    ingest.stream_annotations(stream(), *known, path, checkpoint).awaitTermination()  # nothing new
    assert ingested(spark, path) == WANT


def test_a_limit_holds_over_restarts(spark, tmp_path, known):
    """Five lines: the first file and one of the next, whenever the stream is started and whatever comes later."""
    lines, path, checkpoint = f"{tmp_path}/lines", f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    counters, read = ingest.Counters(spark), 0
    for k, d in enumerate(DELIVERIES):
        deliver(spark, lines, d)
        if k != 1:
            run = ingest.stream_annotations(ingest.file_stream(spark, lines, LINE, 1, total_limit=5), *known, path, checkpoint)
            run.awaitTermination()
            read = sum(c["read"] for c in counters.of(run).values())
    counters.close()
    assert read == 5
    assert ingested(spark, path) == sorted([WANT[k] for k in range(5) if WANT[k] in (("P1", "G1", "IEA", "b"), ("P2", "G1", None, None))], key=repr)


def test_streams_pass_over_a_table_loaded_before(spark, tmp_path, known):
    lines, path = f"{tmp_path}/lines", f"{tmp_path}/table"
    deliver(spark, lines, DELIVERIES[1])
    held = spark.createDataFrame([("P2", "G1", None, "old")], LINE)
    counters = ingest.Counters(spark)
    run = ingest.stream_annotations(ingest.file_stream(spark, lines, LINE), *known, path, f"{tmp_path}/checkpoint", existing=held)
    run.awaitTermination()
    assert ingested(spark, path) == sorted([("P1", "G1", "IEA", "c"), ("P2", "G2", "IDA", "z")], key=repr)
    assert list(counters.of(run).values()) == [{"read": 4, "valid": 4, "inserted": 2}]
    counters.close()


def test_pages_are_counted_over_batches(spark, tmp_path, known):
    lines, path = f"{tmp_path}/lines", f"{tmp_path}/counts"
    for d in DELIVERIES:
        deliver(spark, lines, d)
    paged = ingest.file_stream(spark, lines, LINE).withColumn("page", F.col("go_id"))
    ingest.count_pages(paged, *known, "page", path, f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(ingest.page_counts(spark, path, "page")) == [("G1", 6, 5), ("G2", 5, 5), ("G9", 1, 0)]


def test_totals_hold_whoever_listened(spark, tmp_path, known):
    """Streams killed in their second batch and started again by runs that nobody listens to: lines read, valid and inserted are exact; without lines they are 0."""
    lines, path, counts = f"{tmp_path}/lines", f"{tmp_path}/table", f"{tmp_path}/counts"
    for d in DELIVERIES:
        deliver(spark, lines, d)
    write = ingest._replace_batch(path)

    def killed(batch, number):
        write(batch, number)
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingest.stream_annotations(ingest.file_stream(spark, lines, LINE), *known, path, f"{tmp_path}/a", sink=killed).awaitTermination()
    ingest.stream_annotations(ingest.file_stream(spark, lines, LINE), *known, path, f"{tmp_path}/a").awaitTermination()
    ingest.count_pages(ingest.file_stream(spark, lines, LINE).withColumn("page", F.lit(1).cast("long")), *known, "page", counts, f"{tmp_path}/b").awaitTermination()
    assert rows(ingest.totals(spark, path, counts, "page")) == [(12, 10, len(WANT))]
    for empty in ("no_table", "no_counts"):
        (tmp_path / empty).mkdir()
    assert rows(ingest.totals(spark, f"{tmp_path}/no_table", f"{tmp_path}/no_counts", "page")) == [(0, 0, 0)]


def test_counts_keep_no_state(spark, tmp_path, known, monkeypatch):
    """Counting pages leaves no state store behind; the table's state is RocksDB's, whose changes are written, and the session's settings stay."""
    lines, before = f"{tmp_path}/lines", dict(spark.conf.getAll)
    spark.createDataFrame([("P1", "G1", "IDA", 1), ("P1", "G1", "IDA", 1), ("P9", "G1", "IDA", 2)], "protein string, go_id string, evidence_code string, page long").coalesce(1).write.parquet(lines)
    stream = ingest.file_stream(spark, lines, "protein string, go_id string, evidence_code string, page long")
    ingest.count_pages(stream, *known, "page", f"{tmp_path}/counts", f"{tmp_path}/a").awaitTermination()
    ingest.stream_annotations(stream.drop("page"), *known, f"{tmp_path}/table", f"{tmp_path}/b").awaitTermination()
    assert not (tmp_path / "a" / "state").exists()
    assert list((tmp_path / "b" / "state").rglob("*.changelog")) and dict(spark.conf.getAll) == before
    assert rows(ingest.page_counts(spark, f"{tmp_path}/counts", "page")) == [(1, 2, 2), (2, 1, 0)]
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1
