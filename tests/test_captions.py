import time

import numpy as np
import pandas as pd

from gridloam.operators import captions

PAGE = "source string, page int, {} int, x0 double, y0 double, x1 double, y1 double"


def frames(spark, boxes, blocks):
    """Boxes (page, y0, y1) and blocks (page, y0, y1, text), numbered in their order."""
    box = pd.DataFrame([("a", p, i, 0.0, y0, 9.0, y1) for i, (p, y0, y1) in enumerate(boxes)], columns=["source", "page", "box", "x0", "y0", "x1", "y1"])
    block = pd.DataFrame([("a", p, i, 0.0, y0, 9.0, y1, t) for i, (p, y0, y1, t) in enumerate(blocks)], columns=["source", "page", "block", "x0", "y0", "x1", "y1", "text"])
    return spark.createDataFrame(box, PAGE.format("box")), spark.createDataFrame(block, PAGE.format("block") + ", text string")


def test_every_box_against_all_captions(spark):
    rng = np.random.default_rng(5)
    # tenths, whose sums and differences round differently, and few enough places for ties
    place = lambda: float(rng.integers(-9000, 9000)) / 10
    boxes = [(int(rng.integers(3)), y, y + int(rng.integers(400)) / 10) for y in (place() for _ in range(400))]
    blocks = [(int(rng.integers(3)), y, y + int(rng.integers(300)) / 10, f"{('Fig.', 'Table')[i % 2]} {i}") for i, y in enumerate(place() for _ in range(120))]
    blocks += [(p, y1 + d, y1 + d + 12.5, f"{kind} {1000 + i}") for i, (p, _, y1) in enumerate(boxes[:60]) for kind in ("Fig.", "Table") for d in [(-10, 120, 0, 60, 199.9)[i % 5]]]
    figures, tables = {}, {}
    for n, (page, y0, y1) in enumerate(boxes):
        found, under = [], []
        for b, (p, b0, b1, text) in enumerate(blocks):
            down, up = b0 - y1, b1 - y0
            far = min(abs(down), abs(up))
            rank = 0 if -10 <= down <= 120 else 1 if -60 <= up <= 10 else 2 if far < 200 else None
            if p == page and text.startswith("Fig") and rank is not None:
                found.append((rank, far if rank == 2 else 0, b))
            if p == page and text.startswith("Table") and 0 <= down <= 60:
                under.append(b)
        figures[n] = blocks[min(found)[2]][3] if found else None
        tables[n] = blocks[min(under)][3] if under else f"Table on page {page}"
    df = frames(spark, boxes, blocks)
    assert {r["box"]: r["caption"] for r in captions.figure_captions(*df).collect()} == figures
    assert {r["box"]: r["caption"] for r in captions.table_captions(*df).collect()} == tables


def test_places_of_a_box_that_are_missing(spark):
    df = frames(spark, [(1, None, 100.0), (1, 300.0, None), (1, None, None), (2, 0.0, 100.0)], [(1, 110.0, None, "Fig. 1"), (1, None, 290.0, "Fig. 2"), (2, None, None, "Fig. 3")])
    assert {r["box"]: r["number"] for r in captions.figure_captions(*df).collect()} == {0: 1, 1: 2, 2: None, 3: None}


def test_a_page_of_many_captions_makes_no_pairs(spark):
    """20,000 boxes and captions within one band: 800 million pairs if each met each."""
    n = 20_000
    for kind, f in (("Fig.", captions.figure_captions), ("Table", captions.table_captions)):
        df = frames(spark, [(1, i / n, 50 + i / n) for i in range(n)], [(1, 60 + i / n, 70 + i / n, f"{kind} {i}") for i in range(n)])
        start = time.monotonic()
        got = f(*df).groupBy("caption").count().collect()
        assert [tuple(r) for r in got] == [(f"{kind} 0", n)]
        assert time.monotonic() - start < 60
