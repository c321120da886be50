"""Many small files: few partitions read them, tasks write them and their fixes."""

from pyspark.sql import functions as F

from siftline.config import Config
from siftline.plans.lint import lint_files
from siftline.sinks import fixes
from siftline.sinks.files import put_all
from siftline.sources.jsonl import read_lines
from siftline.sources.python_calls import read_sources


def folder_of(spark, tmp_path, n, text):
    names = spark.range(n).select(F.concat(F.lit("g="), F.col("id") % 3, F.lit("/part="), "id", F.lit(".py")).alias("name"), F.lit(text).alias("content"))
    put_all(names, f"file://{tmp_path}/many")
    return f"{tmp_path}/many"


def test_small_files_take_few_partitions(spark, tmp_path):
    folder, own = folder_of(spark, tmp_path, 200, "a = 1\nb = 2\n"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        sources = read_sources(spark, [folder])
        assert sources.rdd.getNumPartitions() <= 20
        assert sources.distinct().count() == 200
        lines = read_lines(spark, [folder], ".py").groupBy("path").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        assert sorted({tuple(r.rows) for r in lines.collect()}) == [(1, 2)] and lines.count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)


def test_local_fixes_are_written_by_tasks(spark, tmp_path, monkeypatch):
    folder = folder_of(spark, tmp_path, 30, "import random\nrandom.shuffle([1])\n")
    monkeypatch.setattr(fixes, "replace", None)  # what the driver writes with
    done = fixes.apply(lint_files(spark, [folder], Config(enable=("random-seed-not-set",))))
    assert (done.files, done.edits) == (30, 30)
    assert {r.source for r in read_sources(spark, [folder]).collect()} == {"import random\nrandom.seed(0)\nrandom.shuffle([1])\n"}
    assert len([p for p in (tmp_path / "many").rglob("*") if p.is_file()]) == 30


def test_fixes_take_old_checksums_away(spark, tmp_path):
    spark.createDataFrame([("import random\nrandom.shuffle([1])",)], "value string").coalesce(1).write.text(f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*.txt")
    path = file.rename(file.with_suffix(".py"))
    (tmp_path / "out" / f".{file.name}.crc").rename(tmp_path / "out" / f".{path.name}.crc")
    assert fixes.apply(lint_files(spark, [f"file://{path}"], Config(enable=("random-seed-not-set",)))).files == 1
    assert [r.line for r in read_lines(spark, [str(path)]).orderBy("row").collect()][1] == "random.seed(0)"
