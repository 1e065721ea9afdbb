"""What tables of many times the size showed: plans that send more to the driver than they say, and cells by tiles."""

import random
import re

import pyarrow as pa
import pytest

from sightline.operators import cluster as C
from sightline.operators import layout as Y
from sightline.operators import spatial as P
from sightline.plans import registry
from sightline.sources import sinks


def sent(df) -> list[str]:
    """What a plan sends to every task, by the lines under each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(re.match(r"[ :+*-]*", x)[0])
    out = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((n for n in range(k + 1, len(lines)) if depth(lines[n]) <= depth(line)), len(lines))
            out.append("\n".join(lines[k:end]))
    return out


def test_spread_rays_are_not_sent_to_every_task(spark, sf):
    assert not [x for x in sent(registry.QUERIES["cylinder_hits"](spark, sf)) if "Generate" in x]


def flood(cells, steps):
    left, out = set(cells), {}
    while left:
        first = min(left)
        todo = [first]
        left.remove(first)
        while todo:
            c = todo.pop()
            out[c] = first
            for i, j in steps:
                n = (c[0] + i, c[1] + j)
                if n in left:
                    left.remove(n)
                    todo.append(n)
    return out


@pytest.fixture
def given(monkeypatch):
    """Edges that ``components`` gets."""
    seen, whole = [], C.components

    def counted(edges, *args, **kwargs):
        seen.append(edges.count())
        return whole(edges, *args, **kwargs)

    monkeypatch.setattr(C, "components", counted)
    return seen


@pytest.mark.parametrize("eight", [False, True])
def test_components_over_the_sides_of_tiles(spark, monkeypatch, eight):
    """A spiral and loose cells over tiles of four cells, on both sides of zero, in two rooms and one without a name."""
    rng = random.Random(3)
    loose = {(x, y) for x in range(-14, 10) for y in range(-9, 13) if rng.random() < 0.5}
    spiral = {(x, y) for k in range(0, 12, 2) for x in range(-k - 20, k + 1 - 20) for y in (-k - 30, k - 30)} | {(x, y) for k in range(0, 12, 2) for y in range(-k - 30, k + 1 - 30) for x in (-k - 20, k - 20)}
    cells = loose | spiral
    monkeypatch.setattr(P, "TILE", 2)
    df = spark.createDataFrame([(room, x, y, f"{x} {y}") for room in (5, 7, None) for x, y in sorted(cells)], "room long, ix long, iy long, more string")
    got = P.labelled(df, "room", lambda edges: C.components(edges, few=0), eight).collect()
    want = flood(cells, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (eight or not i or not j)])
    for room in (5, 7):
        assert {(r.ix, r.iy): (r.root.room, r.root.ix, r.root.iy) for r in got if r.room == room} == {c: (room, *root) for c, root in want.items()}
    assert len(got) == 3 * len(cells) and all(r.more == f"{r.ix} {r.iy}" and (r.room is not None or r.root[1:] == (r.ix, r.iy)) for r in got)


def test_neighbours_in_a_tile_are_joined_there(spark, sf, given):
    """Grids of a few thousand cells a room give ``components`` no edges, or only those over the sides of tiles."""
    for name in ("grid_components", "supported_cells", "unseen_pockets", "partition_walls", "equipment_boxes"):
        registry.QUERIES[name](spark, sf).collect()
        assert not given, name


def test_a_spread_room_is_not_sent_to_every_task(spark, sf, monkeypatch):
    found, kept = [], P.kept
    monkeypatch.setattr(P, "kept", lambda df, name: (found.extend(x for x in sent(df) if "Generate" in x and name == "tiles"), kept(df, name))[1])
    registry.QUERIES["unseen_pockets"](spark, sf)
    assert not found


def test_walls_are_runs_of_cells_that_repeat(spark):
    cells = spark.createDataFrame([(0, x, 4) for x in range(-3, 5)] * 2 + [(0, 9, y) for y in (1, 2, 2, 4)], "room long, ix long, iy long")
    assert [tuple(r) for r in Y.walls(cells, "room", 3).collect()] == [(0, "x", 4, -3, 4)]


def test_boxes_of_keys_over_many_batches():
    rows = [(None, 1)] * 3 + [(0, 1)] * 5 + [(0, 2)] + [(1, 2)] * 4
    batch = lambda part: pa.RecordBatch.from_pylist([{"room": r, "cx": c, "v": v} for r, c, v in part], schema=pa.schema({"room": pa.int64(), "cx": pa.int64(), "v": pa.int64()}))
    numbered = [(*r, k) for k, r in enumerate(rows)]
    for width in (1, 2, 5, 99):
        got = [t.to_pylist() for t in Y.in_groups([batch(numbered[k : k + width]) for k in range(0, len(rows), width)] + [batch([])], ("room", "cx"))]
        assert [[(r["room"], r["cx"]) for r in g] for g in got] == [[k] * n for k, n in (((None, 1), 3), ((0, 1), 5), ((0, 2), 1), ((1, 2), 4))]
        assert [r["v"] for g in got for r in g] == list(range(len(rows)))


def test_label_files_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Small as they are, files of many images are made by several tasks, each image's by one."""
    monkeypatch.setattr(sinks, "IMAGES", 10, raising=False)
    labels = spark.range(180).selectExpr("id % 60 as image", "0 as class", "0.5d as cx", "0.5d as cy", "0.1d as w", "0.1d as h")
    assert sinks.label_files(labels, str(tmp_path / "labels")) == 60
    files = list((tmp_path / "labels").glob("split=*/image=*/part-*"))
    assert len(files) == 60 and len({f.name[:10] for f in files}) > 1
    assert all(f.read_text().splitlines() == ["0 0.500000 0.500000 0.100000 0.100000"] * 3 for f in files)
