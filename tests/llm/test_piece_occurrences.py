from __future__ import annotations

import numpy as np
import public_tokenizers
from docweave.llm import piece_dropout as pd

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pd.pieces(PATH)
WORD = " understanding"


def forms(ids):
    """Segmentations of the words of a text, by their ids."""
    begins = [i for i, x in enumerate(ids) if MODEL.raw[MODEL.starts[x] : MODEL.starts[x] + 1].tobytes() == b" "]
    return [tuple(ids[a:b]) for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]


def test_every_occurrence_is_cut_on_its_own():
    text = (WORD * 400).strip()
    ids, _ = pd.encode_texts(MODEL, [text], np.array([7]), 0.1, 5)
    assert len(set(forms(ids.tolist()))) > 4
    ids, counts = pd.encode_texts(MODEL, [WORD.strip()] * 300, np.arange(300), 0.3, 5)
    ends = np.cumsum(counts)
    assert len({tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends, strict=True)}) > 4


def by_hand(symbols, key, dropout):
    """One unit by the definition: the best candidate by score, then place, is taken; those at skipped turns go."""
    parts, gone, turn = [(i, i + 1, x) for i, x in enumerate(symbols)], set(), 0
    skip, draw = int(pd.gaps(np.array([key]), 0, dropout)[0]), 0
    while True:
        found = []
        for (a, _, x), (_, c, y) in zip(parts, parts[1:], strict=False):
            merged, rank = MODEL.pair(np.array([x]), np.array([y]))
            if rank[0] >= 0 and (a, x, c) not in gone:
                found.append((rank[0], a, x, c, merged[0]))
        if not found:
            return [x for _, _, x in parts]
        _, a, x, c, merged = min(found)
        if turn == skip:
            gone.add((a, x, c))
            draw += 1
            skip = turn + 1 + int(pd.gaps(np.array([key]), draw, dropout)[0])
        else:
            k = [p[0] for p in parts].index(a)
            parts[k : k + 2] = [(a, c, merged)]
        turn += 1


def test_reuse_gives_what_merging_each_occurrence_gives(monkeypatch):
    texts = [(WORD * 50 + " of the other words in this text" * 20).strip(), "", "the " * 90, "x" * 500 + " and so on", "pneumonoultramicroscopicsilicovolcanoconiosis " * 9]
    keys = np.array([3, 4, -5, 6, 9])
    seen = []
    plain = pd.merge_units
    monkeypatch.setattr(pd, "merge_units", lambda model, symbols, bounds, keys, dropout, skipped=None: seen.append((symbols, bounds, keys, dropout, out := plain(model, symbols, bounds, keys, dropout, skipped))) or out)
    for dropout in (0.05, 0.3, 0.9, 1.0):
        ids, counts = pd.encode_texts(MODEL, texts, keys, dropout, 2)
        symbols, bounds, own_keys, _, (done, done_counts) = seen[-1]
        ends = np.cumsum(done_counts)
        for k in range(0, len(bounds) - 1, 1 + len(bounds) // 60):
            assert by_hand(symbols[bounds[k] : bounds[k + 1]].tolist(), own_keys[k], dropout) == done[ends[k] - done_counts[k] : ends[k]].tolist()
        for k in range(len(texts)):  # whatever else is in the block
            own, n = pd.encode_texts(MODEL, texts[k : k + 1], keys[k : k + 1], dropout, 2)
            assert own.tolist() == ids[counts[:k].sum() :][: counts[k]].tolist() and n[0] == counts[k]


def test_equal_skips_share_their_pieces():
    """Each occurrence merged alone, without any sharing, gives the same ids."""
    words = (" understanding of internationalization " * 60).split()
    text, key = " ".join(words), np.array([11])
    ids, _ = pd.encode_texts(MODEL, [text], key, 0.2, 3)
    codes = [MODEL.symbol[pd.MARK if c == " " else ord(c)] for c in " " + text]
    want, at = [], 0
    for w in words:
        raw = np.array([pd.MARK, *map(ord, w)]).astype(np.int64)
        content = pd.mix(pd.Prefix(pd.mix(raw.astype(np.uint64) + np.uint64(7))).of(np.array([0]), np.array([len(raw)])) + np.uint64(len(raw)))
        own = pd.mix(content + np.uint64(3) + pd.mix(pd.mix(key.astype(np.uint64) + np.uint64(1)) + np.uint64(at)))
        want += by_hand(codes[at : at + len(raw)], own[0], 0.2)
        at += len(raw)
    assert ids.tolist() == want


def test_skips_have_the_rate_asked_for():
    keys = np.arange(20000).astype(np.uint64)
    owner, turn = pd.skips(pd.mix(keys), np.full(20000, 40), 0.1)
    assert len(set(zip(owner.tolist(), turn.tolist(), strict=True))) == len(owner)
    rate = np.bincount(turn, minlength=40) / 20000
    assert abs(rate.mean() - 0.1) < 0.002 and (abs(rate - 0.1) < 0.01).all()
    together = np.zeros((20000, 40))
    together[owner, turn] = 1
    assert abs(np.corrcoef(together.T) - np.eye(40)).max() < 0.04


def test_documents_share_no_variant(spark):
    df = spark.createDataFrame([(i, "internationalization of standardized representations " * 3) for i in range(200)], "doc_id long, text string")
    rows = pd.encode(df, PATH).collect()
    assert len({r.variant for r in rows}) == 200 and len({tuple(r.piece_ids) for r in rows}) > 100 and all(r.lossless for r in rows)
