"""Extraction in runs: shared answers, failures that can be queried, slices as asked for."""

import pytest

from graphloom.operators import backends, extract
from graphloom.plans import lifecycles


class Logged(backends.RuleBackend):
    """Writes each prompt it is asked to a file; answers none that hold ``bad``, and may die at the second stage."""

    def __init__(self, folder, bad="Bad", dies=False):
        self.folder, self.bad, self.dies = str(folder), bad, dies

    def generate(self, system, prompts):
        import uuid

        if self.dies and system == extract.RELATION_PROMPT:
            raise SystemExit
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{system[:5]}|{p}\n".replace("\n", " ") + "\n" for p in prompts)
        return [None if self.bad in p else a for p, a in zip(prompts, super().generate(system, prompts))]


def asked(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def records(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_shared_answers_are_asked_once(spark, tmp_path, log):
    texts = ("Ann met Bob.", "Ann met Bob.", "Cid met Dan.", None, " ")
    config = extract.ExtractConfig(rerun_rounds=0, answers=str(tmp_path / "answers"), save_entity=True)
    plain = tmp_path / "plain"
    assert lifecycles.extract_to(records(spark, *texts), str(tmp_path / "a"), Logged(log), config) == 0
    once = asked(log)
    assert len(once) == len(set(once)) == 4  # two texts, two stages
    assert lifecycles.extract_to(records(spark, *texts), str(tmp_path / "b"), Logged(log), config) == 0
    assert asked(log) == once
    lifecycles.extract_to(records(spark, *texts), str(plain), backends.RuleBackend(), extract.ExtractConfig(save_entity=True))
    rows = lambda p: sorted(str(r) for r in spark.read.parquet(str(p)).select("id", "text", "entity", "triple").collect())
    assert rows(plain) == rows(tmp_path / "a") == rows(tmp_path / "b") and len(rows(plain)) == 5
    other = extract.ExtractConfig(rerun_rounds=0, answers=config.answers, model="other")
    lifecycles.extract_to(records(spark, *texts), str(tmp_path / "c"), Logged(log), other)
    assert len(asked(log)) == 8


def test_a_killed_run_asks_nothing_twice(spark, tmp_path, log):
    config = extract.ExtractConfig(rerun_rounds=0, answers=str(tmp_path / "answers"))
    rows, out = records(spark, "Ann met Bob.", "Cid met Dan."), str(tmp_path / "out")
    with pytest.raises(Exception):
        lifecycles.extract_to(rows, out, Logged(log, dies=True), config)
    assert len(asked(log)) == 2
    assert lifecycles.extract_to(rows, out, Logged(log), config) == 0
    assert len(asked(log)) == 4 and spark.read.parquet(out).count() == 2


def test_failures_are_kept_until_a_run_succeeds(spark, tmp_path, log):
    rows, out, lost = records(spark, "Ann met Bob.", "Bad Eve.", "Bad Fay."), str(tmp_path / "out"), str(tmp_path / "lost")
    config = extract.ExtractConfig(rerun_rounds=0, save_interval=1, answers=str(tmp_path / "answers"))
    assert lifecycles.open_failures(spark, lost, out) is None
    assert lifecycles.extract_to(rows, out, Logged(log), config, failures=lost) == 2
    assert lifecycles.extract_to(rows, out, Logged(log, bad="Fay"), config, failures=lost) == 1
    left = lifecycles.open_failures(spark, lost, out).collect()
    assert [(r["id"], r["times"] >= 2) for r in left] == [(2, True)]
    assert lifecycles.extract_to(rows, out, Logged(log, bad="none"), config, failures=lost) == 0
    assert lifecycles.open_failures(spark, lost, out).count() == 0


def test_slices_hold_every_row_once(spark):
    rows = spark.range(700).selectExpr("id % 350 as id", "id as v").unionByName(spark.createDataFrame([(None, 700)], "id long, v long"))
    parts = [p.collect() for p in lifecycles._slices(rows, "id", 50)]
    assert len(parts) == 8 and sorted(r["v"] for p in parts for r in p) == list(range(701))
    ids = [{r["id"] for r in p} for p in parts]
    assert sum(len(i) for i in ids) == 351


def jobs_of(spark, work):
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_dont_grow_with_the_slices(spark, tmp_path):
    config = extract.ExtractConfig(save_interval=2)
    few, many = (
        jobs_of(spark, lambda: lifecycles.extract_to(records(spark, *["Ann met Bob."] * n), str(tmp_path / f"{n}"), backends.RuleBackend(), config)) for n in (4, 40)
    )
    assert many <= few + 4 and spark.read.parquet(str(tmp_path / "40")).count() == 40


def test_what_tasks_have_asked_outlives_a_kill(spark, tmp_path, log):
    """A run dies at one text, its second stage included; the run after it doesn't ask what ended before."""

    class Dies(Logged):
        def generate(self, system, prompts):
            if self.dies and any("Die" in p for p in prompts):
                import time

                time.sleep(5)
                raise SystemExit
            return backends.RuleBackend.generate(self, system, prompts) if self.dies else super().generate(system, prompts)

    rows, out = records(spark, *[f"Ann met {n}." for n in ("Bob", "Cid", "Dan", "Eve", "Die", "Fay")]), str(tmp_path / "out")
    config = extract.ExtractConfig(rerun_rounds=0, save_interval=1)
    with pytest.raises(Exception):
        lifecycles.extract_to(rows, out, Dies(log, dies=True), config)
    assert lifecycles.extract_to(rows, out, Dies(log), config) == 0
    assert len(asked(log)) < 12 and sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(6))


def test_evaluation_jobs_dont_grow_with_the_slices(spark, tmp_path):
    import json

    from graphloom.operators import cluster

    kg = {"entities": ["Ann"], "edges": ["met"], "relations": [["Ann", "met", "Bob"]]}
    made = {}
    for n in (1, 6):
        data = [{"id": str(i), "extracted_kg": kg, "relational_facts": {"high": [{"fact": "ann met bob"}, {"fact": "zed"}]}} for i in range(n)]
        (tmp_path / f"{n}.json").write_text(json.dumps(data))
        run = lambda n=n: made.update({n: lifecycles.evaluate_dataset(spark, str(tmp_path / f"{n}.json"), str(tmp_path / f"o{n}"), cluster.hashing_embedder(), backends.RuleBackend(), save_interval=1).first()})
        made[f"jobs{n}"] = jobs_of(spark, run)
    assert made["jobs6"] <= made["jobs1"] + 4 and (made[6]["total_facts"], made[6]["correct_facts"]) == (12, 6)
