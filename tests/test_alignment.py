"""Aligning captions with transcripts: against brute force, and without words in joins, shuffles or broadcasts."""

import random
import re

from weftlens.operators import joins as J
from weftlens.plans import catalogue


def aligned(words, tokens, reach):
    """``(file, i): (label, matched)`` of ``file: [word]`` and ``file: [(word, label)]``."""
    key = lambda w: re.sub(r"[^a-z0-9']", "", (w or "").lower())
    out = {}
    for f, said in words.items():
        held = tokens.get(f, [])
        for i, w in enumerate(said) if held else ():
            spot = min(int(i / len(said) * len(held)), len(held) - 1)
            near = [(abs(j - spot), j) for j, (t, _) in enumerate(held) if key(t) and key(t) == key(w) and -reach <= j - spot < reach]
            label = held[min(near)[1]][1] if near else None
            out[f, i] = (held[spot][1] if label is None else label, bool(near))
    return out


def test_align_by_position_against_brute_force(spark):
    rng = random.Random(13)
    vocabulary = ["Yes", "yes,", "no", "It's", "-", "", "a b", "ab", "amen", None]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    words = {f: draw(rng.randrange(1, 60)) for f in range(1, 30)} | {40: draw(400)}
    tokens = {f: [(w, rng.choice(["A", "B", None])) for w in draw(rng.randrange(1, 60))] for f in range(3, 33)} | {40: [(w, "A") for w in draw(500)]}
    said = spark.createDataFrame([(f, i, w) for f, ws in words.items() for i, w in enumerate(ws)] + [(None, 0, "no")], "file long, pos int, word string")
    held = spark.createDataFrame([(f, j, w, who) for f, ts in tokens.items() for j, (w, who) in enumerate(ts)] + [(None, 0, "no", "A")], "file long, pos int, word string, speaker string")
    for reach in (1, 4, 80):
        found = J.align_by_position(said, held, "file", "pos", "word", "speaker", reach)
        assert found.dtypes == [("file", "bigint"), ("pos", "int"), ("speaker", "string"), ("matched", "boolean")]
        rows = found.collect()
        assert len(rows) == len({(r.file, r.pos) for r in rows})
        assert {(r.file, r.pos): (r.speaker, r.matched) for r in rows} == aligned(words, tokens, reach)


def test_files_are_cut_between_files_only():
    import pyarrow as pa

    turns = [[{"label": "A", "words": ["x"] * 3}], [], None, [{"label": "B", "words": ["y"] * 9}, {"label": "C", "words": None}], [{"label": "D", "words": ["z"]}]]
    kind = pa.list_(pa.struct([("label", pa.string()), ("words", pa.list_(pa.string()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["x"], ["x"], [], ["y"], None], pa.list_(pa.string())), pa.array(turns, kind)], names=["file", "words", "turns"])
    for most in (1, 4, 5, 100):
        parts = list(J._file_slices(batch, most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        found = [(part.column(0)[int(r)].as_py(), int(i), who, bool(ok)) for part in parts for r, i, who, ok in zip(*(x.to_pylist() if isinstance(x, pa.Array) else x for x in J._nearest_labels(part.column(1), part.column(2), 80)))]
        assert found == [(0, 0, "A", True), (3, 0, "B", True)]


def test_words_of_transcripts_stay_with_their_file(spark, sf_dir):
    """The size of a small parquet file says little of the words in it: a join planned by it broadcast all of them."""
    df = catalogue.queries()["jon_13_align_by_position"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "Scan ExistingRDD" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
