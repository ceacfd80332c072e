"""Media fragments, sound descriptors, visual words, loudness, people and tracks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors


def seconds(text: Column) -> Column:
    """Seconds of plain, mm:ss or h:mm:ss time; null if malformed."""
    part = F.split(text, ":")
    n = F.size(part)
    value = lambda i: F.get(part, i).try_cast("double")
    clock = text.rlike(r"^(\d+:)?\d{1,2}:\d{2}(\.\d+)?$")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double")).when(clock & (n == 2), value(F.lit(0)) * 60 + value(F.lit(1))).when(clock, value(F.lit(0)) * 3600 + value(F.lit(1)) * 60 + value(F.lit(2)))


def fragment(reference: Column) -> Column:
    """path, begin and end of a reference with an optional #t=begin,end; an empty or malformed
    fragment is an error."""
    path = F.regexp_extract(reference, r"^([^#]*)", 1)
    t = F.regexp_extract(reference, r"#t=(?:npt:)?([^,]*)(?:,(.*))?$", 1)
    u = F.regexp_extract(reference, r"#t=(?:npt:)?([^,]*)(?:,(.*))?$", 2)
    has = F.contains(reference, F.lit("#"))
    begin = F.when(t == "", F.lit(0.0)).otherwise(seconds(t))
    end = F.when(u == "", F.lit(None).cast("double")).otherwise(seconds(u))
    wrong = has & (~F.contains(reference, F.lit("#t=")) | ((t == "") & (u == "")) | begin.isNull() | ((u != "") & end.isNull()) | (end <= begin))
    made = F.struct(path.alias("path"), F.when(has, begin).alias("begin"), F.when(has, end).alias("end"))
    return F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("malformed fragment: "), reference))).otherwise(made)


@lru_cache
def _mel_bands(rate: int, fft: int, bands: int) -> np.ndarray:
    """Triangles of equal area over a scale that is linear up to 1 kHz and logarithmic beyond."""
    step, corner, growth = 200 / 3, 1000.0, np.log(6.4) / 27
    top = corner / step + np.log(rate / 2 / corner) / growth if rate / 2 > corner else rate / 2 / step
    mel = np.linspace(0, top, bands + 2)
    hz = np.where(mel < corner / step, mel * step, corner * np.exp(growth * (mel - corner / step)))
    at = np.fft.rfftfreq(fft, 1 / rate)[None, :]
    low, mid, high = (hz[i : i + bands, None] for i in range(3))
    return np.clip(np.minimum((at - low) / (mid - low), (high - at) / (high - mid)), 0, None) * 2 / (high - low)


def _slope(x: np.ndarray, width: int, order: int) -> np.ndarray:
    """Derivative of that order of the least-squares polynomial of that degree around each row."""
    half = width // 2
    weights = np.linalg.pinv(np.vander(np.arange(-half, half + 1.0), order + 1, increasing=True))[order] * order  # order! of 1 and 2
    padded = np.concatenate([x[:1].repeat(half, 0), x, x[-1:].repeat(half, 0)])
    return sum(w * padded[i : i + len(x)] for i, w in enumerate(weights))


def mfcc(samples: np.ndarray, rate: int = 16_000, coefficients: int = 13, fft: int = 512, window: int = 400, hop: int = 160, bands: int = 128, width: int = 9) -> np.ndarray:
    """Cepstral coefficients of each window of a mono signal, then their first and second slopes;
    no rows for an empty signal."""
    x = np.asarray(samples, float)
    if not len(x):
        return np.zeros((0, 3 * coefficients), np.float32)
    padded = np.pad(x, fft // 2)
    hann = np.pad(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window), ((fft - window) // 2, fft - window - (fft - window) // 2))
    frames = np.lib.stride_tricks.sliding_window_view(padded, fft)[::hop]
    mel = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2 @ _mel_bands(rate, fft, bands).T
    level = 10 * np.log10(np.maximum(mel, 1e-10))
    level = np.maximum(level, level.max() - 80)
    cosines = np.cos(np.pi * np.arange(coefficients)[:, None] * (np.arange(bands) + 0.5) / bands) * np.sqrt(2 / bands)
    cosines[0] /= np.sqrt(2)
    base = level @ cosines.T
    return np.hstack([base, _slope(base, width, 1), _slope(base, width, 2)]).astype(np.float32)


def mfcc_frames(df: DataFrame, key: str, samples: str, rate: int = 16_000) -> DataFrame:
    """(key, frame, descriptor) of each sound: an array of mono samples at ``rate``; null has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            for k, x in zip(part[key], part[samples]):
                rows = mfcc([] if x is None else x, rate)
                if len(rows):
                    yield pd.DataFrame({key: pd.Series([k] * len(rows), dtype=part[key].dtype), "frame": np.arange(len(rows)), "descriptor": list(rows)})

    return df.select(key, samples).mapInPandas(run, f"`{key}` {kind}, frame long, descriptor array<float>")


def visual_words(descriptors: DataFrame, key: str, column: str, vocabulary: list[list[float]]) -> DataFrame:
    """(key, word, n): how often the nearest of a bounded vocabulary's words occurs in each object."""
    return vectors.ivf_assign(descriptors, column, vocabulary).groupBy(key, F.col("list_id").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def bag_tf_idf(counts: DataFrame, key: str, word: str, n: str) -> DataFrame:
    """(key, word, weight): share of the object's words times ln(objects / objects with the word)."""
    total = counts.select(F.count_distinct(key)).first()[0]
    per = counts.groupBy(key).agg(F.sum(n).alias("all"))
    having = counts.groupBy(word).agg(F.count_distinct(key).alias("having"))
    weight = F.col(n) / F.col("all") * F.log(F.lit(float(total)) / F.col("having"))
    return counts.join(per, key).join(having, word).select(key, word, weight.alias("weight"))


def loudness(blocks: DataFrame, by: str, start: str, power: str, size: float, hop: float, block: float = 0.1, gate: float = -50.0) -> DataFrame:
    """(by, window, dbfs, silent): mean power of the blocks that begin in each window, floor -120.

    A block is dealt to the windows over it, so there is no join of blocks and windows.
    """
    last = F.floor((F.col(start) + 1e-9) / hop)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(start) - size + 1e-9) / hop) + 1)
    each = blocks.withColumn("window", F.explode(F.sequence(first, last)))
    mean = F.avg(power)
    level = F.when(mean <= 1e-12, F.lit(-120.0)).otherwise(F.greatest(F.lit(-120.0), 10 * F.log10(mean)))
    return each.groupBy(by, "window").agg(level.alias("dbfs")).withColumn("silent", F.col("dbfs") < gate)


def best_per_person(neighbours: DataFrame, shot: str, person: str, score: str) -> DataFrame:
    return neighbours.groupBy(shot, person).agg(F.max(score).alias("score"))


def resemblance(neighbours: DataFrame, shot: str, person: str, score: str) -> DataFrame:
    """(person, score): mean over all shots of the best score; a person that a shot lacks counts
    there with the lowest of the shot's people."""
    best = best_per_person(neighbours, shot, person, score)
    floors = best.groupBy(shot).agg(F.min("score").alias("floor"))
    total = floors.agg(F.count(F.lit(1)).alias("shots"), F.sum("floor").alias("floors")).first()
    over = best.join(floors, shot).groupBy(person).agg(F.sum(F.col("score") - F.col("floor")).alias("more"))
    return over.select(person, ((F.col("more") + float(total.floors or 0)) / float(max(1, total.shots))).alias("score"))


def medoids(df: DataFrame, key: str, column: str, by: str) -> DataFrame:
    """(by, key): of each group the vector nearest to the group's mean direction."""
    means = vectors.mean_vector(df, column, [by])
    scored = df.join(means, by).select(by, key, vectors.similarity(F.col(column), F.col("mean")).alias("s"))
    return scored.groupBy(by).agg(F.min(F.struct((-F.round("s", 9)).alias("s"), F.col(key).alias("k"))).alias("m")).select(by, F.col("m.k").alias(key))


def iou(a, b) -> float:
    """Overlap of two boxes (x, y, width, height) as a share of their union."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inner = max(0.0, w) * max(0.0, h)
    return inner / (a[2] * a[3] + b[2] * b[3] - inner) if inner else 0.0


def track(frames: DataFrame, session: str, ts: str, min_iou: float = 0.3, lost_seconds: float = 1.0) -> DataFrame:
    """Rows (session, ts, x, y, w, h) with track_id: boxes of a frame go to the open tracks by
    falling overlap; a track not seen for ``lost_seconds`` ends. A session is one stream in time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, "x", "y"], kind="stable").reset_index(drop=True)
        ids, open_, new = [0] * len(pdf), {}, 1
        for now, frame in pdf.groupby(ts, sort=True):
            open_ = {k: v for k, v in open_.items() if now - v[1] < lost_seconds}
            boxes = {i: tuple(frame.loc[i, ["x", "y", "w", "h"]]) for i in frame.index}
            pairs = sorted(((iou(v[0], b), -k, -i) for i, b in boxes.items() for k, v in open_.items()), reverse=True)
            got: dict[int, int] = {}
            for score, k, i in pairs:
                if score >= min_iou and -i not in got and -k not in got.values():
                    got[-i] = -k
            for i, b in boxes.items():
                if i not in got:
                    got[i], new = new, new + 1
                ids[i] = got[i]
                open_[got[i]] = (b, now)
        return pdf.assign(track_id=ids)

    columns = frames.select(session, ts, "x", "y", "w", "h")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields) + ", track_id long"
    return columns.groupBy(session).applyInPandas(run, schema)
