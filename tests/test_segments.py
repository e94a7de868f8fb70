"""Markdown sections, short blocks, video regions and the frames of segments."""

import numpy as np
import pytest

from lodestar.operators import chunk, video


def unit(*degrees):
    r = np.radians(degrees)
    return np.stack([np.cos(r), np.sin(r)], axis=1)


def test_sections_are_cut_by_level_only_where_too_large():
    words = "word " * 30
    small = f"# A\n\n{words}\n\n## B\n\n{words}\n"
    assert [(c.path, c.start) for c in chunk.chunk_markdown(small)] == [(("A",), 0)]
    large = f"# A\n\n## B\n\n{words * 2}\n\n### C\n\n{words}\n\n## D\n\n{words * 2}\n"
    assert [c.path for c in chunk.chunk_markdown(large)] == [("A", "B"), ("A", "D")]
    assert [n.path for n in chunk._with_paths(chunk.markdown_nodes("# A\n\n### C\n\n### D\n\n## B\n\nx"))][-1] == ("A", "B")
    assert chunk.chunk_markdown("# A\n\n---\n") == []


def test_packing_leaves_no_short_rest():
    # 300 + 150 would be nearer to the target, but then 100 would stay alone; 150 + 100 fit together.
    text = "\n\n".join(["a" * 300, "b" * 150, "c" * 100])
    nodes = chunk.markdown_nodes(text)
    assert [len(c.text) for c in chunk.pack_section(text, nodes, len, 250, 400, 500)] == [301, 252]  # a block has its line's end
    quote = "> " + "q" * 700
    assert [c.oversized for c in chunk.pack_section(quote, chunk.markdown_nodes(quote), len, 250, 400, 500)] == ["indivisible_content_node"]


@pytest.mark.parametrize(("sizes", "expected"), [((300, 150, 150), [300, 301]), ((300, 150), [451]), ((300, 150, 700), [451, 700])])
def test_short_blocks_join_forward_if_those_suffice(sizes, expected):
    text = " ".join("x" * n for n in sizes)
    chunks, at = [], 0
    for n in sizes:
        chunks.append(chunk.Chunk(text[at : at + n], at, at + n, ("A",)))
        at += n + 1
    assert [len(c.text) for c in chunk.join_short(text, chunks, len, 250, 600)] == expected


def plain_chain(e, threshold):
    groups = [[i] for i in range(len(e))]
    while len(groups) > 1:
        gaps = [np.mean([1 - e[i] @ e[j] for i in a for j in b]) for a, b in zip(groups, groups[1:], strict=False)]
        k = int(np.argmin(gaps))
        if gaps[k] > threshold:
            break
        groups[k] += groups.pop(k + 1)
    return [n for n, g in enumerate(groups) for _ in g]


@pytest.mark.parametrize("seed", range(5))
def test_chains_as_by_all_pairs(seed):
    e = unit(*np.random.default_rng(seed).uniform(0, 120, 40))
    for threshold in (0.05, 0.2, 3):
        assert video.chain_clusters(e, threshold) == plain_chain(e, threshold)
    assert video.chain_clusters(np.zeros((0, 2)), 0.1) == []
    assert video.chain_clusters(e[:1], 0.1) == [0]


def test_absorption():
    e = unit(0, 1, 70, 90, 91)
    assert video.absorb_runs([0, 0, 1, 2, 2], e) == [0, 0, 2, 2, 2]
    assert video.absorb_runs([0, 0, 1, 0, 0], unit(0, 1, 5, 0, 1)) == [0] * 5
    assert video.absorb_runs([0], e[:1]) == [0] and video.absorb_runs([], e[:0]) == []
    sums = [unit(0)[0], unit(80)[0], unit(90)[0]]
    assert video.merge_short([(0, 2000), (2000, 2500), (2500, 9000)], sums=sums) == [(0, 2000), (2000, 9000)]
    assert len(sums) == 2


def test_shift_costs_keep_a_boundary():
    at = np.arange(0, 12000, 500.0)
    costs = video.shift_costs(at, np.where(at < 4000, 0.0, 50.0), [4000, 8000])
    assert costs.tolist() == [1, 0]
    e = unit(0, 0, 0)
    assert video.merge_to_target([4, 4, 4], e, 10, 15, 0.9, shifts=costs) == [[0], [1, 2]]
    assert video.shift_costs(at, at, []).size == 0


def test_video_of_two_scenes(spark):
    rows = [(1, i * 500, [1.0, 0.0] if i < 24 else [0.0, 1.0]) for i in range(48)] + [(2, 0, [1.0, 0.0])]
    got = video.segment_videos(spark.createDataFrame(rows, "video long, at long, embedding array<double>")).orderBy("video", "segment").collect()
    assert [(r.video, r.start, r.end) for r in got] == [(1, 0, 11750), (1, 11750, 23501), (2, 0, 1)]


def test_frames_of_segments_by_brute_force(spark):
    rng = np.random.default_rng(3)
    segments, frames = [], []
    for v in range(4):
        cuts = np.unique(rng.integers(0, 200, 12)).tolist()
        segments += [(v, f"{v}_{a}", a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        frames += [(v, v * 1000 + i, int(t)) for i, t in enumerate([*rng.integers(0, 220, 15), cuts[-1], cuts[-1]])]
    expected = set()
    for v, s, a, b in segments:
        last = b == max(x[3] for x in segments if x[0] == v)
        near = [(abs(t - (a + b) / 2), f) for w, f, t in frames if w == v]
        own = [f for w, f, t in frames if w == v and (a <= t < b or (last and t == b))]
        expected |= {(s, f) for f in own or [min(near)[1]]}
    got = video.frames_of(
        spark.createDataFrame(segments, "video long, segment_id string, start long, end long"),
        spark.createDataFrame(frames, "video long, frame_id long, at long"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


def test_merging_a_long_video_takes_no_square_of_its_regions():
    """each merge looked at all pairs again; 1,500 regions took 20.8 s, now 0.1 s."""
    import time

    import numpy as np

    from lodestar.operators import video

    sums, began = np.random.default_rng(0).normal(size=(6000, 16)) + 0.5, time.time()
    groups = video.merge_to_target([0.5] * 6000, sums, 15.0, 22.0, -1.0)
    assert [i for g in groups for i in g] == list(range(6000)) and len(groups) < 600 and time.time() - began < 20
