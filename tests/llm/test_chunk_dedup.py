import numpy as np

from rosterloom.llm import chunk_dedup


def pieces(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = chunk_dedup.cuts(data, np.array([0, len(data)]))
    return [text.encode()[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def test_gear_is_the_rolling_hash(prose):
    data = np.frombuffer(prose(1, 200).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 2**32
        want.append(h)
    assert chunk_dedup.gear(data).tolist() == want


def test_cuts_resist_insertions(prose):
    text = prose(2, 600)
    before, after = pieces(text), pieces("an insertion of some words " + text)
    assert b"".join(before) == text.encode()
    assert len(set(before) & set(after)) >= len(before) - 3
    assert len(pieces("x" * 50_000)) >= 50_000 // chunk_dedup.GREATEST


def test_shared_passages_are_found_and_others_are_not(spark, prose):
    passages = [prose(1000 + k, 51) for k in range(40)]
    rows = [(i, prose(i, 150)) for i in range(60)]
    for k, passage in enumerate(passages):
        for side in (0, 1):
            words = prose(5000 + 2 * k + side, 120).split()
            at = (7 * k + 13 * side) % 100
            rows.append((100 + 2 * k + side, " ".join([*words[:at], passage, *words[at:]])))
    found = {r.doc_id: r for r in chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(found) == len(rows)
    assert [i for i in range(60) if found[i].repeats] == []
    assert [i for i in range(100, 180) if not found[i].repeats] == []
    assert all(found[i].other_docs == [i ^ 1] for i in range(100, 180))


def naive_pieces(data):
    """Pieces of a text, byte by byte."""
    h, offered = 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 2**32
        low = h % 2**chunk_dedup.WINDOW
        if low < 2 ** (chunk_dedup.WINDOW - chunk_dedup.MASK_BITS) and i >= chunk_dedup.WINDOW - 1:
            offered.append((i, low))
    taken = [i + 1 for i, v in offered if not any(j != i and abs(i - j) < chunk_dedup.APART and (w < v or (w == v and j < i)) for j, w in offered)]
    ends, last = [], 0
    for end in sorted({*taken, len(data)}) if data else []:
        ends += [*range(last + chunk_dedup.GREATEST, end, chunk_dedup.GREATEST), end]
        last = end
    snapped = set()
    for end in ends:
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        snapped.add(end)
    return list(zip([0, *sorted(snapped)[:-1]], sorted(snapped)))


def brute(rows):
    """Whole rows: rows are (doc_id, text), in order."""
    chunks = []
    for _, text in rows:
        found = naive_pieces((text or "").encode())
        chunks.append([(a[0], b[1]) for a, b in zip(found, found[1:])] or found)
    places = {}
    for i, (_, text) in enumerate(rows):
        for a, b in chunks[i]:
            places.setdefault((text or "").encode()[a:b], []).append((i, a))
    out = []
    for i, (doc, text) in enumerate(rows):
        data, runs = (text or "").encode(), []
        for a, b in chunks[i]:
            at = places[data[a:b]]
            if len(at) > 1:
                if not runs or a > runs[-1][-1][1]:
                    runs.append([])
                runs[-1].append((a, b))
        runs = [r for r in runs if max(b for _, b in r) - r[0][0] >= chunk_dedup.LEAST]
        other = lambda a, b: next((x for x in (places[data[a:b]][0][0], places[data[a:b]][-1][0]) if x != i), None)  # noqa: E731, B023
        across, others = [], set()
        for r in runs:
            shared = [(a, b) for a, b in r if other(a, b) is not None]
            across.append(max(b for _, b in shared) - shared[0][0] if shared else 0)
            if across[-1] >= chunk_dedup.LEAST:
                others |= {rows[other(a, b)][0] for a, b in shared}
        of = [c for r in runs for c in r]
        out.append((doc, len(chunks[i]), len(data), len(of), sum(places[data[a:b]][0] != (i, a) for a, b in of), max(across, default=0) >= chunk_dedup.LEAST,
                    sum(r[-1][1] - r[0][0] for r in runs), max((len(places[data[a:b]]) for a, b in of), default=0), [(r[0][0], r[-1][1]) for r in runs], sorted(others)))
    return out


def test_rows_are_those_of_brute_force(spark, prose):
    accents = "ñe lló ção rra üb 漢字 dé"
    passages = [prose(9000 + k, 40 + k, accents if k % 2 else "ba be bi do du fa") for k in range(6)]
    rows = [(i, f"{prose(i, 30)} {passages[i % 6] if i % 3 else ''} {prose(50 + i, 20, accents)} {passages[(i + 2) % 6] if i % 4 == 0 else ''}") for i in range(30)]
    rows += [(100, passages[0] + " " + passages[0] + " " + passages[0]), (101, None), (102, ""), (103, "short"), (104, "short"), (105, "x" * 20_000), (106, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted((tuple([tuple(p) for p in v] if k == "passages" else v for k, v in r.asDict().items()) for r in chunk_dedup.repeated_passages(frame).collect()))
    assert found == sorted(brute(rows))


def test_later_copies_are_removed(spark, prose):
    passage = prose(1, 80)
    rows = [(i, f"{prose(10 + i, 40)} é {passage} ü {prose(40 + i, 40)}") for i in range(6)] + [(20, prose(99, 60)), (21, None), (22, "")]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, _row int").coalesce(1)
    kept = chunk_dedup.without_repeated_passages(frame)
    assert kept.columns == frame.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert passage in texts[0] and {i: texts[i] for i in (0, 20, 21, 22)} == {i: dict(rows)[i] for i in (0, 20, 21, 22)}
    words = passage.split()
    for i in range(1, 6):
        assert texts[i].startswith(prose(10 + i, 39)) and texts[i].endswith(prose(40 + i, 40).split(" ", 1)[1])
        assert sum(w in words for w in texts[i].split()) < 25 and " ".join(words[20:60]) not in texts[i]
    assert chunk_dedup.repeated_passages(kept).filter("n_removable > 0").count() == 0


def test_odd_rows(odd_rows, no_rows):
    rows = chunk_dedup.repeated_passages(odd_rows).collect()
    assert len(rows) == 16
    assert all(r.n_chunks == 0 and not r.repeats for r in rows if r.doc_id in (3, 4))
    assert [r.repeats for r in rows if r.doc_id in (1, 2, 12)] == [True] * 4
    assert [r.repeats for r in rows if r.doc_id == 10] == [False]
    assert chunk_dedup.repeated_passages(no_rows).count() == 0
