from __future__ import annotations

import random

from docweave.functions.styles import style_chains


def walk(up):
    out = set()
    for style in up:
        depth, at, seen = 0, style, [style]
        while True:
            to = up[at]
            ended = "Root" if to is None else "StyleInheritanceCycle" if to in seen else "BrokenStyleReference" if to not in up else None
            out.add((style, depth, at, ended))
            if ended:
                break
            depth, at = depth + 1, to
            seen.append(to)
    return out


def chains(spark, up):
    rows = [tuple(r) for r in style_chains(spark.createDataFrame(list(up.items()), "style long, based_on long")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_chain_deeper_than_any_bound(spark):
    up = {i: i - 1 if i else None for i in range(301)}
    rows = chains(spark, up)
    assert rows == walk(up) and (300, 300, 0, "Root") in rows


def test_roots_missing_styles_and_cycles(spark):
    rng = random.Random(4)
    up = {i: rng.choice([None, i, i + 1, max(0, i - 1), rng.randrange(90), rng.randrange(70), rng.randrange(70)]) for i in range(70)}
    up |= {i: i + 1 for i in range(200, 260)} | {260: 230, 300: 301, 301: 300, 302: 301, 400: 999}
    assert chains(spark, up) == walk(up)
    assert chains(spark, {1: 1}) == {(1, 0, 1, "StyleInheritanceCycle")}
