"""Two writers of one table: numbers without gap, one refused where both continue the same history."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pagestrata.errors import AuditError
from pagestrata.operators import records as K
from pagestrata.sources import tables as T
from pagestrata.sources.commits import CommittedTable


def attempts(spark, key, numbers):
    modes = ["initial", "targeted-repair", "human-authorized-retry", "human-authorized-retry"]
    rows = [(key, n, modes[n]) for n in numbers]
    frame = spark.createDataFrame(rows, "input_digest string, attempt int, mode string")
    kinds = {c.split(" ")[0]: c for c in ("model_digest string", "provider_config string", "evaluation_digest string", "gate_status string")}
    frame = frame.withColumns({name: F.lit("x") for name in kinds}).withColumn("created_at", F.current_timestamp())
    empty = spark.createDataFrame([], T.LEDGER)
    return frame.unionByName(empty, allowMissingColumns=True).select(*empty.columns)


def test_writers_of_the_same_history(spark, tmp_path):
    root = str(tmp_path)
    T.store_attempts(root, attempts(spark, "a", [0]))
    ready = threading.Barrier(2)

    def write(_):
        rows = attempts(spark, "a", [1])
        ready.wait()
        try:
            T.store_attempts(root, rows)
            return "written"
        except AuditError as error:
            return error.code

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(write, range(2))) == ["INVALID_REJECTION_SEQUENCE", "written"]
    ledger = T.read_ledger(spark, root)
    assert sorted((r.input_digest, r.attempt) for r in ledger.collect()) == [("a", 0), ("a", 1)]
    assert K.sequence_violations(ledger).isEmpty()
    with pytest.raises(AuditError):
        T.store_attempts(root, attempts(spark, "a", [3]))
    T.store_attempts(root, attempts(spark, "a", [2, 3]))
    assert T.read_ledger(spark, root).count() == 4


def test_writers_of_different_rows_all_get_a_number(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t", "k string, n int")
    ready, seen = threading.Barrier(4), []

    def write(k):
        ready.wait()

        def checked(held):
            seen.append(k)
            return spark.createDataFrame([(k, held.count())], "k string, n int")

        return table.append(checked)[0]

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(write, "abcd")) == [1, 2, 3, 4]
    # What a writer saw when it was checked is what came before its commit.
    assert sorted(r.n for r in table.rows().collect()) == [0, 1, 2, 3] and len(seen) >= 4
    assert [n for n, _ in table.commits()] == [1, 2, 3, 4]


def test_broken_appends_are_not_read(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t", "k string")
    assert table.rows().count() == 0

    def refused(held):
        raise AuditError("NO", "no")

    with pytest.raises(AuditError):
        table.append(refused)
    spark.createDataFrame([("staged",)], "k string").write.parquet(f"{tmp_path}/t/data/left-over")
    table.append(lambda held: spark.createDataFrame([("kept",)], "k string"))
    assert [r.k for r in table.rows().collect()] == ["kept"]
    (tmp_path / "t/commits/1").rename(tmp_path / "t/commits/2")
    with pytest.raises(AuditError):
        table.commits()
