"""Quarantined lines, gzipped members, manifests of steps and published models."""

import gzip
import io
import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.sources import gzip_lines, readers
from topicloom.sources.materialize import Place, Step

GOOD = [{"domain": f"d{n}", "orig_domain": "o", "categories": "a|b", "text": f"t{n} é"}
        for n in range(9)]


def test_broken_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = [json.dumps(GOOD[0]), '{"domain": "cut', json.dumps(GOOD[1]), "", "   ", "no json"]
    two = ["[1, 2]", *map(json.dumps, GOOD[2:]), '{"domain": {"x": 1}}', '{"unknown": 1}', "null"]
    (tmp_path / "in" / "one.jl").write_text("\n".join(one) + "\n")
    with gzip.open(tmp_path / "in" / "two.jl.gz", "wt") as out:
        out.write("\n".join(two))
    pages, bad = readers.read_pages_checked(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert pages.columns == ["orig_domain", "domain", "categories", "text"]
    domains = [r.domain for r in pages.collect()]
    assert sorted(d for d in domains if d and d.startswith("d")) == [f"d{n}" for n in range(9)]
    found = {(os.path.basename(r.file), r.line): r.record for r in bad.collect()}
    assert found[("one.jl", 2)] == one[1] and found[("one.jl", 6)] == "no json"
    for (file, line), record in found.items():
        assert record == (one if file == "one.jl" else two)[line - 1]
    # Every line that is not blank is in one of the two.
    assert len(domains) + len(found) == len([x for x in one + two if x.strip()])
    none = readers.read_pages_checked(spark, f"{tmp_path}/in/one.jl", f"{tmp_path}/again")
    assert none[0].count() == 2 and none[1].count() == 2


def members(lines, sizes, draw=None):
    out, at = b"", 0
    for size in sizes:
        out += gzip.compress("".join(f"{x}\n" for x in lines[at:at + size]).encode(),
                             compresslevel=draw.choice([0, 1, 9]) if draw else 9)
        at += size
    return out


def test_members_are_tasks(spark, tmp_path):
    draw = random.Random(1)
    lines = ["".join(draw.choice("abé \x1f\x8b{") for _ in range(draw.randrange(80)))
             for _ in range(3000)]
    (tmp_path / "a.gz").write_bytes(members(lines, [100] * 30, draw))
    (tmp_path / "one.gz").write_bytes(members(lines[:500], [500]))
    (tmp_path / "empty.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "note.txt").write_text("no gzip")
    plain = sorted(r.value for r in spark.read.text([f"{tmp_path}/a.gz", f"{tmp_path}/one.gz"])
                   .collect())
    for step in (997, 20_000, 64 << 20):
        read = gzip_lines.read_gzip_lines(spark, str(tmp_path), step)
        assert sorted(r.value for r in read.collect()) == plain
    parts = gzip_lines.read_gzip_lines(spark, f"{tmp_path}/a.gz", 5000)
    filled = parts.groupBy(F.spark_partition_id()).count().collect()
    assert len(filled) > 5 and sum(r["count"] for r in filled) == 3000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab\x1f\x8b\x08é", max_size=12), max_size=6), max_size=8),
       st.integers(1, 90), st.randoms(use_true_random=False))
def test_ranges_read_every_line_once(texts, step, draw):
    data = b"".join(members(lines, [len(lines)], draw) for lines in texts)
    found = []
    for start in range(0, len(data), step):
        part = gzip_lines.Range("f", start, min(start + step, len(data)), len(data))
        for lines in gzip_lines.range_lines(io.BytesIO(data), part):
            found += [x.decode() for x in lines]
    assert found == [x for lines in texts for x in lines]


def test_members_must_end_with_a_line(tmp_path):
    data = gzip.compress(b"one\ntw") + gzip.compress(b"o\n")
    part = gzip_lines.Range("f", 0, len(data), len(data))
    with pytest.raises(ValueError, match="ends within a line"):
        list(gzip_lines.range_lines(io.BytesIO(data), part))
    last = gzip.compress(b"one\n") + gzip.compress(b"two")
    part = gzip_lines.Range("f", 0, len(last), len(last))
    assert list(gzip_lines.range_lines(io.BytesIO(last), part)) == [[b"one", b"two"]]


def test_steps_are_due_when_inputs_or_parameters_change(spark, tmp_path):
    source, ran = tmp_path / "in", []
    source.mkdir()
    (source / "a.txt").write_text("1")

    def run(name, inputs, outputs, later=(), **parameters):
        def work():
            ran.append(name)
            for path in outputs:
                spark.range(1).write.parquet(path)

        return Step(spark, outputs, later, inputs, parameters).run(work)

    one, two, three = (f"{tmp_path}/{n}" for n in ("one", "two", "three"))

    def job(size=1, flag=False):
        ran.clear()
        run("one", [f"{source}/*.txt"], [one], [two, three])
        run("two", [one], [two], [three], size=size)
        run("three", [two], [three], flag=flag)
        return list(ran)

    assert job() == ["one", "two", "three"]
    assert job() == []
    assert job(flag=True) == ["three"]
    assert job(size=2, flag=True) == ["two", "three"]
    (source / "b.txt").write_text("2")
    assert job(size=2, flag=True) == ["one", "two", "three"]
    (source / "_hidden.txt").write_text("no input")
    assert job(size=2, flag=True) == []
    os.utime(source / "a.txt", (1, 1))
    assert job(size=2, flag=True) == ["one", "two", "three"]
    # Results of a step without a note are made again, those of one without inputs are not.
    (tmp_path / "three" / "_manifest").unlink()
    assert job(size=2, flag=True) == ["three"]
    assert Step(spark, [three]).due() is False
    assert Step(spark, []).due() is False
    assert Place(spark, three).made_from() is not None


def test_file_outputs_have_their_manifest_beside_them(spark, tmp_path):
    path = tmp_path / "x.txt"

    def step(size):
        return Step(spark, [str(path)], inputs=[], parameters={"size": size})

    assert step(1).run(lambda: path.write_text("1")) and not step(1).due()
    assert step(2).due()
    assert (tmp_path / "_x.txt.manifest").exists()
