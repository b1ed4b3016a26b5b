import operator
from pathlib import Path

from pairloom.functions.tokenizers import WhiteSpaceTokenizer
from pairloom.plans.executor import Blocker
from pairloom.plans.predicates import JaccardPredicate
from pairloom.plans.program import KeepRule, Program
from pairloom.sources import scratch
from pairloom.streaming.blocking import block_stream


def test_streamed_search_side_gives_the_batch_result(spark, rows, tmp_path):
    a = spark.createDataFrame([(1, "red sea"), (2, "blue sky"), (3, None)], "_id long, t string")
    b = spark.createDataFrame([(10 + i, t) for i, t in enumerate(["red sea", "sky blue", None, "x"])], "_id long, t string")
    b.repartition(3).write.parquet(str(tmp_path / "in"))
    program = Program([KeepRule([JaccardPredicate("t", "t", WhiteSpaceTokenizer(), operator.ge, 0.5)])])
    got = []
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    block_stream(a, stream, program, lambda pairs, _: got.extend(map(tuple, pairs.collect())), str(tmp_path / "state")).awaitTermination()
    assert sorted(got) == rows(Blocker(a, b).pairs(program)) == [(1, 10), (2, 11)]


def test_batches_leave_no_scratch_tables_and_share_the_index(spark, tmp_path):
    a = spark.createDataFrame([(1, "red sea"), (2, "blue sky")], "_id long, t string")
    for i in range(4):
        spark.createDataFrame([(10 + i, "red sea")], "_id long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    program = Program([KeepRule([JaccardPredicate("t", "t", WhiteSpaceTokenizer(), operator.ge, 0.5)])])
    held, got = [], []

    def sink(pairs, _):
        got.extend(map(tuple, pairs.collect()))
        held.append(len(list(Path(scratch.shared_dir(spark).removeprefix("file://")).glob("pairloom-*"))))

    stream = spark.readStream.schema("_id long, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    block_stream(a, stream, program, sink, str(tmp_path / "state")).awaitTermination()
    assert sorted(got) == [(1, 10 + i) for i in range(4)] and len(held) >= 4 and len(set(held)) == 1
