"""Job lists over voxel files against brute force."""

import numpy as np
import pytest

from octavox.operators import jobs
from octavox.sources import files, shapes


def test_jobs_on_voxel_files(spark, tmp_path):
    rng = np.random.default_rng(21)
    cells = rng.random((30, 8, 8, 8)) < 0.5
    cells[3] |= cells[2]
    cells[7] = False
    table = spark.createDataFrame([(i, *map(int, c)) for i in range(30) for c in np.argwhere(cells[i])], "shape_id long, x int, y int, z int")
    words = shapes.to_words(table, 3)
    for r in files.to_voxel_files(words, 3, 0.5).collect():
        (tmp_path / f"{r['title']}.mira").write_bytes(bytes(r["content"]))
    core = spark.createDataFrame([(100, *map(int, c)) for c in np.argwhere(cells[2] & cells[3] & (rng.random((8, 8, 8)) < 0.05))], "shape_id long, x int, y int, z int")
    for r in files.to_voxel_files(shapes.to_words(core, 3), 3, 0.5).collect():
        (tmp_path / "core.mira").write_bytes(bytes(r["content"]))
    # one zero word keeps the empty shape in the searched table
    whole = words.selectExpr("shape_id", "cast(block as long) as block", "bits").union(spark.createDataFrame([(7, 0, 0)], "shape_id long, block long, bits long"))
    text = "NNSearch dir/2.mira 3\nDCSearch 5.mira 0.5 0.5\nDCSearch 2.mira 1 20\nDCSearch2 2.mira core.mira 3.mira\nNNSearch 4.mira 0\nDCSearch 5.mira 0 0\n\nNNSearch late.mira 1\n"
    (tmp_path / "list").write_text(text)
    listed, read = files.read_jobs(spark, str(tmp_path / "list")), files.read_voxel_files(spark, str(tmp_path))
    got = {}
    for r in jobs.run(listed, read, whole, 3, 0.5).collect():
        got.setdefault((r["job"], r["file"]), []).append((r["rank"], r["object_id"], r["score"]))

    def step(c, grow):
        pad = np.pad(c, 1, constant_values=not grow)
        near = [pad[1 + i : 9 + i, 1 + j : 9 + j, 1 + k : 9 + k] for i, j, k in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        return np.any(near, axis=0) if grow else np.all(near, axis=0)

    def many(c, grow, n):
        for _ in range(n):
            c = step(c, grow)
        return c

    def far(a, b):
        return 1.0 - (a & b).sum() / (a | b).sum() if (a | b).any() else 0.0

    def ranked(q, own, k=None):
        best = sorted((float(far(cells[q], cells[i])), i) for i in own)[:k]
        return [(n + 1, i, d) for n, (d, i) in enumerate(best)]

    fits = lambda small, big: [i for i in range(30) if not (small & ~cells[i]).any() and not (cells[i] & ~big).any()]
    inner = np.zeros((8, 8, 8), bool)
    for r in core.collect():
        inner[r["x"], r["y"], r["z"]] = True
    want = {
        (0, "dir/2.mira"): ranked(2, range(30), 3), (1, "5.mira"): ranked(5, fits(step(cells[5], False), step(cells[5], True))), (2, "2.mira"): ranked(2, fits(many(cells[2], False, 2), many(cells[2], True, 40))),
        (3, "2.mira"): ranked(2, fits(inner, cells[3])), (4, "4.mira"): ranked(4, range(30)), (5, "5.mira"): ranked(5, fits(cells[5], cells[5])),
    }
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(want[3, "2.mira"]) >= 2
    objects = spark.createDataFrame([(i, f"shape {i}") for i in range(30)], "shape_id long, title string")
    first = jobs.lines(jobs.run(listed, read, whole, 3, 0.5), objects).where("job = 0").orderBy("rank").first()["value"]
    assert first == "RES dir/2.mira\tshape 2\t0"
    for wrong in ("NNSearch gone.mira 1", "Other 2.mira 1"):
        (tmp_path / "wrong").write_text(wrong)
        with pytest.raises(ValueError):
            jobs.run(files.read_jobs(spark, str(tmp_path / "wrong")), read, whole, 3, 0.5)
    (tmp_path / "wrong").write_text("NNSearch 2.mira 1")
    with pytest.raises(ValueError):
        jobs.run(files.read_jobs(spark, str(tmp_path / "wrong")), read, whole, 4, 0.5)
