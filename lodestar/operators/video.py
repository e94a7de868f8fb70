"""Numeric segmentation of video time series: windows where order suffices, group functions for greedy merges."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("video").orderBy("ts", "event_id")


def frame_change(rows: DataFrame, first: float | None = 0.0) -> DataFrame:
    """`change`: absolute difference of value to the frame before; `first` for a video's first frame."""
    change = F.abs(F.col("value") - F.lag("value").over(_order()))
    return rows.withColumn("change", change if first is None else F.coalesce(change, F.lit(first)))


def rolling_max(rows: DataFrame, radius: int) -> DataFrame:
    return rows.withColumn("high", F.max("value").over(_order().rowsBetween(-radius, radius)))


def adaptive_threshold(rows: DataFrame, low: float = 0.08, high: float = 0.25) -> DataFrame:
    """(video, threshold): upper quartile of `distance`, by linear interpolation, within [low, high]."""
    q = F.expr("percentile(distance, 0.75)")
    return rows.where("distance is not null").groupBy("video").agg(F.greatest(F.lit(low), F.least(F.lit(high), q)).alias("threshold"))


def duration_target(seconds: Column) -> Column:
    raw = 10 * (1 + 0.15 * F.log2(F.greatest(seconds, F.lit(10.0)) / 10))
    return F.greatest(F.lit(10.0), F.least(F.lit(20.0), raw))


def runs(rows: DataFrame) -> DataFrame:
    """(video, label, first_event, length): maximal runs of equal labels in time order."""
    inner = Window.partitionBy("video", "label").orderBy("ts", "event_id")
    island = F.row_number().over(_order()) - F.row_number().over(inner)
    rows = rows.withColumn("island", island)
    return rows.groupBy("video", "label", "island").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("length"))


def frame_fault(light: Column, contrast: Column, sharp: Column, dark: float, bright: float, flat: float, blurred: float) -> Column:
    """Why a frame is left out: dark, bright, low_contrast or blurry; null for a good one."""
    return (
        F.when(light < dark, "dark").when(light > bright, "bright").when(contrast < flat, "low_contrast").when(sharp < blurred, "blurry")
    )


def chain_clusters(embeddings: np.ndarray, threshold: float) -> list[int]:
    """Labels of average-linkage agglomeration in which only neighbours in time may merge, while their distance is small."""
    n = len(embeddings)
    sums, size = np.array(embeddings, dtype=float), np.ones(n)
    first, following = np.arange(n), np.arange(1, n + 1)
    # Mean pairwise cosine distance of unit vectors is one less the product of the groups' means. A group is known by its
    # first frame; gaps[i] is the distance of the group of frame i to the next one.
    gaps = np.full(n, np.inf)
    gaps[:-1] = 1 - (sums[:-1] * sums[1:]).sum(axis=1)
    before = np.arange(-1, n - 1)
    while n and gaps[k := int(gaps.argmin())] <= threshold:
        taken = following[k]
        sums[k] += sums[taken]
        size[k] += size[taken]
        first[taken], gaps[taken] = k, np.inf
        following[k] = following[taken]
        if following[k] < n:
            before[following[k]] = k
        for i in (before[k], k):
            if i >= 0:
                j = following[i]
                gaps[i] = 1 - (sums[i] @ sums[j]) / (size[i] * size[j]) if j < n else np.inf
    return (np.cumsum(first == np.arange(n)) - 1).tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-12)


def _nearer(sums: list[np.ndarray], i: int) -> int:
    """The neighbour of i in time whose centre is nearer; the earlier one of two."""
    own = _unit(sums[i])
    return min((j for j in (i - 1, i + 1) if 0 <= j < len(sums)), key=lambda j: (1 - float(own @ _unit(sums[j])), j))


def absorb_runs(labels: list[int], embeddings: np.ndarray, least: int = 2) -> list[int]:
    """Labels in which runs of fewer than `least` frames have the label of the nearer neighbour, the first one first."""
    cuts = [i for i in range(len(labels)) if not i or labels[i] != labels[i - 1]]
    spans = [[labels[a], a, b] for a, b in pairwise([*cuts, len(labels)])]
    sums = [embeddings[a:b].sum(axis=0) for _, a, b in spans]
    # Runs before the first short one stay long, so that the search goes on from there.
    at = 0
    while len(spans) > 1 and (i := next((k for k in range(at, len(spans)) if spans[k][2] - spans[k][1] < least), None)) is not None:
        at = max(i - 1, 0)
        spans[i][0] = spans[_nearer(sums, i)][0]
        # Runs of one label that now meet are one; three of them where both neighbours have it.
        for j in (i, i - 1):
            if 0 <= j < len(spans) - 1 and spans[j][0] == spans[j + 1][0]:
                spans[j][2] = spans.pop(j + 1)[2]
                sums[j] = sums[j] + sums.pop(j + 1)
    return [label for label, a, b in spans for _ in range(a, b)]


def merge_short(regions: list[tuple[float, float]], least: float = 1000, sums: list[np.ndarray] | None = None) -> list[tuple[float, float]]:
    """Regions in time order, those shorter than `least` joined to the neighbour whose centre is nearer by the sums of
    their frames (which are changed alike); without sums, to the shorter one."""
    out = list(regions)
    # Regions before the first short one stay long, so that the search goes on from there.
    at = 0
    while len(out) > 1 and (i := next((k for k in range(at, len(out)) if out[k][1] - out[k][0] < least), None)) is not None:
        at = max(i - 1, 0)
        if sums is not None:
            j = _nearer(sums, i)
        else:
            j = min((j for j in (i - 1, i + 1) if 0 <= j < len(out)), key=lambda j: (out[j][1] - out[j][0], j))
        lo, hi = min(i, j), max(i, j)
        out[lo : hi + 1] = [(out[lo][0], out[hi][1])]
        if sums is not None:
            sums[lo] = sums[lo] + sums.pop(hi)
    return out


def boundaries(times: list[float], labels: list[int], end: float) -> list[tuple[float, float]]:
    """Regions of equal labels; a boundary is midway between the samples on both its sides."""
    cuts = [0.0] + [(times[i] + times[i - 1]) / 2 for i in range(1, len(times)) if labels[i] != labels[i - 1]] + [end]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def shift_costs(at: np.ndarray, activity: np.ndarray, ends: list[float], side: float = 1000) -> np.ndarray:
    """How much activity changes at each end: the medians of log activity within `side` on both sides, between the 10th and
    90th percentile of all ends. Without frames on a side its level is 0."""
    if not ends:
        return np.zeros(0)

    def level(a: float, b: float) -> float:
        own = activity[np.searchsorted(at, a) : np.searchsorted(at, b)]
        return math.log1p(float(np.median(own))) if len(own) else 0.0

    raw = np.array([abs(level(e, e + side) - level(e - side, e)) for e in ends])
    low, high = np.quantile(raw, [0.1, 0.9])
    return np.clip((raw - low) / max(float(high - low), np.finfo(float).eps), 0, 1)


def merge_to_target(
    durations: list[float], sums: np.ndarray, target: float, hard: float, gate: float, stop: float = 0.5, shifts: np.ndarray | None = None
) -> list[list[int]]:
    """Neighbouring regions merged greedily by cost .5 (d / target)² + .5 shift while similarity, length and cost allow.

    sums are those of the regions' frames, shifts the costs of the ends of all regions but the last (none: 0).
    """
    n = len(durations)
    groups: list[list[int] | None] = [[i] for i in range(n)]
    size = [float(d) for d in durations]
    total = [np.asarray(x, float) for x in sums]
    shifts = np.zeros(max(n - 1, 0)) if shifts is None else shifts
    # A group is known by its first region; a pair's cost changes only when one of the two does, which its version tells.
    following, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    todo: list[tuple[float, int, int]] = []

    def look(i: int) -> None:
        version[i] += 1
        if (j := following[i]) < n:
            whole = size[i] + size[j]
            if whole <= hard and float(_unit(total[i]) @ _unit(total[j])) >= gate:
                heapq.heappush(todo, (0.5 * (whole / target) ** 2 + 0.5 * float(shifts[groups[i][-1]]), i, version[i]))

    for i in range(n):
        look(i)
    while todo:
        cost, i, of = heapq.heappop(todo)
        if of != version[i]:
            continue
        if cost > stop:
            break
        j = following[i]
        groups[i] += groups[j]
        size[i] += size[j]
        total[i] = total[i] + total[j]
        groups[j], version[j], following[i] = None, -1, following[j]
        if following[i] < n:
            before[following[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return [g for g in groups if g is not None]


def distinct_frames(embeddings: np.ndarray, most_similar: float) -> list[int]:
    """Frames less similar than `most_similar` to the last one kept."""
    kept: list[int] = []
    for i, e in enumerate(embeddings):
        if not kept or float(e @ embeddings[kept[-1]]) < most_similar:
            kept.append(i)
    return kept


def kept_frames(frames: DataFrame, most_alike: float) -> DataFrame:
    """(video, frame_id, reason) of frames(video, at, frame_id, thumbnail array<int>, fault): why a frame is left out, null if it is kept.

    A frame with a fault has that; one whose thumbnail differs from the last kept frame's by `most_alike` or less, as a
    mean over 255, is a near_duplicate. Frames are gone through in the order of time, then frame_id; what goes from one to
    the next is one thumbnail, so a video's length costs no memory. A video is one task's work, as each frame depends on
    those before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last = None, None
        for batch in batches:
            reasons = []
            for own, thumbnail, fault in zip(*(batch.column(c).to_pylist() for c in ("video", "thumbnail", "fault")), strict=True):
                if own != video:
                    video, last = own, None
                now = np.asarray(thumbnail, np.float32)
                if fault is None and last is not None and float(np.abs(now - last).mean()) / 255 <= most_alike:
                    fault = "near_duplicate"
                if fault is None:
                    last = now
                reasons.append(fault)
            yield pa.RecordBatch.from_arrays([batch.column("video"), batch.column("frame_id"), pa.array(reasons, pa.string())], ["video", "frame_id", "reason"])

    rows = frames.select("video", "at", "frame_id", "thumbnail", "fault").repartition("video").sortWithinPartitions("video", "at", "frame_id")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("video", "frame_id")}
    return rows.mapInArrow(run, f"video {kinds['video']}, frame_id {kinds['frame_id']}, reason string")


def segment_representatives(frames: DataFrame, most: int = 3) -> DataFrame:
    """(segment_id, position, frame_id): up to `most` representative frames of each segment of frames(segment_id, at, frame_id, embedding).

    One group function for each segment, which merge_to_target() bounds by time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "frame_id"])
        chosen = representative_frames(np.stack([np.asarray(x, float) for x in pdf["embedding"]]), most)
        return pd.DataFrame({"segment_id": pdf["segment_id"].iloc[0], "position": range(len(chosen)), "frame_id": pdf["frame_id"].iloc[chosen].to_numpy()})

    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("segment_id", "frame_id")}
    return frames.groupBy("segment_id").applyInPandas(run, f"segment_id {kinds['segment_id']}, position int, frame_id {kinds['frame_id']}")


def representative_frames(embeddings: np.ndarray, most: int = 3, least_silhouette: float = 0.15, rounds: int = 50) -> list[int]:
    """Up to `most` frames in time order: the real frame nearest to each centre of the k-means with the best silhouette.

    Centres begin at the first frame and then at the farthest from those chosen, so that the result is determined. One
    frame, the nearest to the mean, where no k separates well.
    """
    from .density import silhouette

    x = embeddings / np.maximum(np.linalg.norm(embeddings, axis=1, keepdims=True), 1e-12)
    best, labels = least_silhouette, np.zeros(len(x), int)
    for k in range(2, min(most, len(x) - 1) + 1):
        centers = [x[0]]
        for _ in range(k - 1):
            centers.append(x[int(np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0).argmax())])
        c = np.array(centers)
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        if len(set(own.tolist())) == k and (s := silhouette(x, own)) > best:
            best, labels = s, own
    return sorted(int(np.flatnonzero(labels == j)[((x[labels == j] - x[labels == j].mean(axis=0)) ** 2).sum(axis=1).argmin()]) for j in set(labels.tolist()))


def frames_of(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """(segment_id, frame_id): frames in [start, end), with the end for the last segment; else the one nearest the middle.

    A video's segments must not overlap. Each frame then meets the latest segment that has begun, by a sort of the video.
    """
    last = F.max("end").over(Window.partitionBy("video"))
    begins = segments.select("video", F.col("start").alias("at"), F.lit(0).alias("turn"), F.struct("segment_id", "end", (F.col("end") == last).alias("last")).alias("seg"))
    order = Window.partitionBy("video").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    both = begins.unionByName(frames.select("video", "at", F.lit(1).alias("turn"), "frame_id"), allowMissingColumns=True)
    both = both.withColumn("seg", F.last("seg", ignorenulls=True).over(order))
    own = both.where("turn = 1 and (at < seg.end or (seg.last and at = seg.end))").select("seg.segment_id", "frame_id")

    middle = ((F.col("start") + F.col("end")) / 2).alias("at")
    empty = segments.join(own.select("segment_id").distinct(), "segment_id", "left_anti").select("video", middle, "segment_id")
    points = frames.groupBy("video", F.col("at").cast("double").alias("at")).agg(F.min("frame_id").alias("frame_id"))
    both = empty.unionByName(points.select("video", "at", F.struct("at", "frame_id").alias("pick")), allowMissingColumns=True)
    until = Window.partitionBy("video").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy("video").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("before", F.max("pick").over(until)).withColumn("after", F.min("pick").over(since)).where("segment_id is not null")
    away = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("away"), F.col(f"{c}.frame_id").alias("frame_id"))) for c in ("before", "after")]
    near = both.select("segment_id", F.least(*away)["frame_id"].alias("frame_id")).where("frame_id is not null")
    return own.unionByName(near)


def segment_videos(frames: DataFrame, threshold: float | None = None, relaxed: float = 0.05) -> DataFrame:
    """(video, segment, start, end) in ms of frames(video, at, embedding[, activity]): chains of alike frames, runs of one
    frame and regions under a second absorbed, then regions merged towards the target duration. Without a threshold each
    video has the upper quartile of its adjacent distances within [.08, .25]. One group function per video, which is
    bounded by its length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        e = np.stack([np.asarray(x, float) for x in pdf["embedding"]])
        e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
        at = pdf["at"].to_numpy(float)
        limit = threshold
        if limit is None:
            limit = float(np.clip(np.quantile(1 - (e[:-1] * e[1:]).sum(axis=1), 0.75), 0.08, 0.25)) if len(e) > 1 else 0.08
        labels = absorb_runs(chain_clusters(e, limit), e)
        cuts = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1])]
        sums = list(np.add.reduceat(e, cuts))
        regions = merge_short(boundaries(at.tolist(), labels, float(at[-1]) + 1), sums=sums)
        activity = pdf["activity"].to_numpy(float) if "activity" in pdf else np.zeros(len(at))
        target = boundary_ratio((at[-1] + 1) / 1000)
        groups = merge_to_target(
            [(b - a) / 1000 for a, b in regions], sums, target, 1.5 * target, float(np.clip(1 - limit - relaxed, -1, 1)),
            shifts=shift_costs(at, activity, [b for _, b in regions[:-1]]),
        )
        spans = [(regions[g[0]][0], regions[g[-1]][1]) for g in groups]
        return pd.DataFrame({"video": pdf["video"].iloc[0], "segment": range(len(spans)), "start": [a for a, _ in spans], "end": [b for _, b in spans]})

    return frames.groupBy("video").applyInPandas(run, "video long, segment int, start double, end double")


def boundary_ratio(seconds: float) -> float:
    """The target as a plain number, for group functions."""
    return min(20.0, max(10.0, 10 * (1 + 0.15 * math.log2(max(seconds, 10) / 10))))
