"""A tree is listed and read by tasks whose number does not follow that of its files."""

from __future__ import annotations

from quillon.sources import readers


def test_files_are_those_of_sparks_reader_in_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    for n in range(700):
        folder = tmp_path / f"a{n % 3}" / ("b" if n % 2 else "_hidden" if n % 7 == 0 else "k=v")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{'.' if n % 11 == 0 else '_' if n % 13 == 0 else ''}f {n}.{'PY' if n % 5 else 'txt'}").write_text(f"ä{n}" * (n % 4))
    (tmp_path / "Makefile").write_text("all:")
    (tmp_path / "none").mkdir()
    got = readers.source_files(spark, str(tmp_path), (".py",), 9)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    want = {(r.path, bytes(r.content).decode()) for r in whole.collect() if r.length <= 9 and r.path.lower().endswith((".py", "/makefile"))}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    assert got.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
