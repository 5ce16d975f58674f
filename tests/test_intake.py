"""A growing log taken in piece by piece equals reading it whole."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.test_extend import lines
from tracewell.functions import facts
from tracewell.operators import parts, profile, trend
from tracewell.sources import intake, readers


def text(rng: random.Random, n: int) -> list[str]:
    return [f"2024-01-01 10:{rng.randrange(60):02d}:00 {rng.choice(['INFO', 'ERROR', 'WARN', 'FATAL'])} [{rng.choice('abc')}] {rng.choice(['ok', 'panic', 'slow'])} v={rng.randrange(500)}" for _ in range(n)]


def same(spark, folder, root) -> None:
    want = facts.with_facts(readers.read_lines(spark, str(folder), skip_split_headers=False))
    got = intake.taken_in(spark, str(root))
    order = lambda df: sorted(map(str, df.select("file", "line_no", "text", *facts.FACTS).collect()))
    assert order(got) == order(want)
    of = lambda p: sorted(str(tuple(r)) for r in p.drop("sketch").collect())
    assert of(intake.stored_profile(spark, str(root))) == of(parts.profile_parts(want))


def test_appends_new_files_rewrites_and_cut_lines(spark, tmp_path):
    rng, folder, root = random.Random(3), tmp_path / "logs", tmp_path / "root"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(text(rng, 40)) + "\n2024-01-01 11:00:00 ERR")
    (folder / "b.log").write_text("\n".join(text(rng, 9)) + "\n")
    (folder / "empty.log").write_text("")
    assert intake.take_in(spark, str(folder), str(root)) == 1 and intake.take_in(spark, str(folder), str(root)) is None
    same(spark, folder, root)
    with open(folder / "a.log", "a") as f:  # the cut line goes on, and more follow
        f.write("OR [b] panic late v=1\n" + "\n".join(text(rng, 15)) + "\n")
    (folder / "c.log").write_text("\n".join(text(rng, 5)))
    assert intake.take_in(spark, str(folder), str(root)) == 2
    same(spark, folder, root)
    taken = {r.file.rsplit("/", 1)[1]: r.n for r in spark.read.parquet(f"{root}/lines/batch=2").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert taken == {"a.log": 16, "c.log": 5}
    (folder / "b.log").write_text("\n".join(text(rng, 30)))  # another file of the same name, and longer
    (folder / "a.log").write_text("short now")
    assert intake.take_in(spark, str(folder), str(root)) == 3
    same(spark, folder, root)
    with open(folder / "b.log", "a") as f:
        f.write("\n")  # only ends its last line
    assert intake.take_in(spark, str(folder), str(root)) == 4
    same(spark, folder, root)


def test_merged_parts_are_the_profile_of_the_union(spark):
    rng = random.Random(4)
    log = lines(spark, text(rng, 300))
    halves = [log.where("line_no < 120"), log.where("line_no >= 120")]
    both = parts.profile_parts(halves[0]).unionByName(parts.profile_parts(halves[1]))
    of = lambda df: sorted(map(str, df.collect()))
    assert of(parts.merge_parts(both).drop("sketch")) == of(parts.profile_parts(log).drop("sketch"))
    assert of(parts.worst_components(both)) == of(profile.merge_analysis(log))
    found = {r.name: r.distinct for r in trend.discover_fields(log).collect()}
    about = {r.name: r.distinct for r in parts.fields_of(both).collect()}
    assert found.keys() == about.keys() and all(abs(about[n] - found[n]) <= 0.1 * found[n] + 1 for n in found)
