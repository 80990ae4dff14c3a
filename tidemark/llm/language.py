"""Language of each text and of each one-language stretch, by a byte convolutional network.

The network (an embedding of bytes, convolutions of several widths, max pooling, softmax) is trained in
numpy on a bounded sample of labelled texts: at most ``SAMPLE_TEXTS`` texts, chosen by a hash, of which
``SAMPLE_CHARS`` characters are read. Labels are noisy, so after a first pass sentences that the network
contradicts are left out and a second pass is trained. The weights are written to the shared folder under a
hash of the sample and the settings, so that a sample is trained on once. They go to every task; whole texts
are then cut into sentences, sentences into fixed-length byte windows, and batches of windows are classified.
A change of language from sentence to sentence must outweigh a penalty (Viterbi over the sentences).

Defined results
---------------
* null, empty and wordless texts (digits, markup, emoji) have no segment and make no case;
* quoted sayings and markup inside a sentence do not vote, unless nothing else is left;
* a label may be a two- or three-letter code, with region or not, or an English name, in any case;
* repeated rows are classified each; extra columns are not read; an empty table gives no rows;
* without a labelled text to train on there is nothing to tell languages apart by: no rows;
* ``outcome`` is the language, or ``other`` where its confidence is under ``SURE``: a language that no label
  of the table names can only show as one of low confidence.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

# Codes (ISO 639-1, 639-2 both ways) and English names of the languages.
NAMES = {
    "en": ["eng", "english"], "de": ["ger", "deu", "german"], "nl": ["dut", "nld", "dutch"], "fr": ["fre", "fra", "french"],
    "es": ["spa", "spanish"], "pt": ["por", "portuguese"], "pl": ["pol", "polish"], "ru": ["rus", "russian"],
}
LANGS = list(NAMES)
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_SENTENCES = 8_000, 1_500, 16_000
WINDOW, EMBED, FILTERS, WIDTHS = 96, 8, 32, (3, 4, 5, 6)
DROPOUT = 0.4
PENALTY = 4.0
SURE = 0.5
#: Windows classified at once: their convolutions stay in a core's cache.
AT_ONCE = 128
WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?:\s|&nbsp;|<[^<>]{0,200}>)+(?:[|/•*-]\s+)?|\n+|(?<!\s)\s+[|/•]\s+|<(?:br|p|/p)\b[^<>]{0,80}>")
MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};|&#\d+;|https?://\S+|[​-‏﻿­]")
QUOTED = re.compile(r"“[^“”]{1,80}”|«[^«»]{1,80}»|„[^„“”]{1,80}[“”]|\"[^\"]{1,80}\"")
BROKEN = re.compile(r"[ÃÂÄÅÐÑ][\u0080-¿Œ-Ÿ–-›€™]")


def label_of(lang: Column) -> Column:
    """Two-letter language that a label column names, null if it names none of ours."""
    plain = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]+)(?:[-_][a-z0-9]{2,8})*$", 1)
    names = {n: code for code, more in NAMES.items() for n in (code, *more)}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), plain)


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, read right again where that works throughout."""
    if len(BROKEN.findall(text)) == 0:
        return text
    for page in ("cp1252", "latin-1"):
        try:
            return text.encode(page).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return re.sub(
        r"[Â-ô][\u0080-¿]+",
        lambda m: m[0].encode("latin-1").decode("utf-8", "replace"),
        text,
    )


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end and votable content of each sentence with words."""
    out, start = [], 0
    for end, nxt in [*((m.start(), m.end()) for m in SENTENCE.finditer(text)), (len(text), len(text))]:
        raw = text[start:end]
        if raw.strip():
            clean = MARKUP.sub("", html.unescape(MARKUP.sub(lambda m: " " if m[0][0] in "<&h" else "", raw))).replace("\xa0", " ")
            clean = repaired(clean)
            plain = QUOTED.sub(" ", clean)
            clean = plain if WORD.search(plain) else clean
            if WORD.search(clean):
                out.append((start, end, " ".join(clean.lower().split())))
        start = nxt
    return out


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows of all texts, and which text each is of. A longer text is cut into windows of like length."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        b = (" " + t + " ").encode("utf-8", "ignore")
        m = max(1, -(-len(b) // WINDOW))
        for k in range(m):
            rows.append(b[k * len(b) // m : (k + 1) * len(b) // m].ljust(WINDOW, b"\0"))
            owner.append(i)
    return np.frombuffer(b"".join(rows), "uint8").reshape(-1, WINDOW), np.array(owner)


class ByteNet:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED)).astype("float32")}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype("float32")
            self.p[f"b{w}"] = np.zeros(FILTERS, "float32")
        self.p["V"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(LANGS))).astype("float32")
        self.p["c"] = np.zeros(len(LANGS), "float32")

    def forward(self, x: np.ndarray, keep: bool = False):
        e = self.p["E"][x]
        e[x == 0] = 0
        flat = e.reshape(len(x), -1)
        feats, cache = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            cols = np.lib.stride_tricks.sliding_window_view(flat, w * EMBED, axis=1)[:, :: EMBED]
            cols = np.ascontiguousarray(cols).reshape(-1, w * EMBED)
            a = (cols @ self.p[f"W{w}"]).reshape(len(x), n, FILTERS)
            if keep:
                at = a.argmax(1)
                top = np.take_along_axis(a, at[:, None], 1)[:, 0]
                cache.append((at, cols.reshape(len(x), n, -1)))
            else:
                top = a.max(1)
            feats.append(np.maximum(top + self.p[f"b{w}"], 0))
        h = np.concatenate(feats, 1)
        z = h @ self.p["V"] + self.p["c"]
        z = z - z.max(1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        return (logp, h, cache) if keep else logp

    def gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        _, h, cache = self.forward(x, keep=True)
        mask = (rng.random(h.shape) >= DROPOUT).astype("float32") / (1 - DROPOUT)  # no few features may decide alone
        h = h * mask
        z = h @ self.p["V"] + self.p["c"]
        dz = np.exp(z - z.max(1, keepdims=True))
        dz /= dz.sum(1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"V": h.T @ dz, "c": dz.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = (dz @ self.p["V"].T) * mask * (h > 0)
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            at, cols = cache[k]
            used = cols[np.arange(len(x))[:, None], at]  # sample, filter, w * EMBED
            g[f"W{w}"] = np.einsum("sf,sfe->ef", d, used, optimize=True)
            g[f"b{w}"] = d.sum(0)
            de = (d[:, :, None] * self.p[f"W{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for j in range(w):
                byte = x[np.arange(len(x))[:, None], at + j].ravel()
                for i in range(EMBED):
                    g["E"][:, i] += np.bincount(byte, weights=de[:, :, j, i].ravel(), minlength=256).astype("float32")
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 4e-3, seed: int = 1) -> None:
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        share = np.bincount(y)[y] ** -0.5
        share /= share.sum()
        for epoch in range(epochs):
            order = rng.choice(len(x), len(x), p=share)  # rare languages more often than they are
            for part in np.array_split(order, max(1, len(order) // batch)):
                t += 1
                for k, g in self.gradients(x[part], y[part], rng).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * 0.65**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype("float32")

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """What ``forward`` gives, without the places of the maxima, for windows in any order.

        Windows of like length go together and are cut behind the longest; a stretch of padding gives 0, so
        the maximum over a window with padding is at least 0.
        """
        pad = self.p["E"].copy()
        pad[0] = 0
        length = (x > 0).sum(1)
        order, h = np.argsort(length, kind="stable"), np.empty((len(x), FILTERS * len(WIDTHS)), "float32")
        for at in range(0, len(x), AT_ONCE):
            rows = order[at : at + AT_ONCE]
            n, wide = length[rows], min(WINDOW, int(length[rows[-1]]) + max(WIDTHS) - 1)
            flat = pad[x[rows, :wide]].reshape(len(rows), wide * EMBED)
            for k, w in enumerate(WIDTHS):
                cols = np.lib.stride_tricks.sliding_window_view(flat, w * EMBED, axis=1)[:, ::EMBED]
                top = (np.ascontiguousarray(cols).reshape(-1, w * EMBED) @ self.p[f"W{w}"]).reshape(len(rows), -1, FILTERS).max(1)
                top = np.where((n <= WINDOW - w)[:, None], np.maximum(top, 0), top)
                h[rows, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top + self.p[f"b{w}"], 0)
        z = h @ self.p["V"] + self.p["c"]
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def sentence_scores(self, texts: list[str]) -> np.ndarray:
        """Log probability of each language for each text, the mean over its windows weighted by their bytes."""
        out, weight = np.zeros((len(texts), len(LANGS))), np.zeros(len(texts))
        x, owner = windows(texts)
        n = (x > 0).sum(1)
        np.add.at(out, owner, self.log_shares(x) * n[:, None])
        np.add.at(weight, owner, n)
        return out / np.maximum(weight, 1)[:, None]


def _stripped(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def training_sample(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, int]]:
    """At most SAMPLE_SENTENCES sentences with the language that their text's label names, from SAMPLE_TEXTS texts chosen by a hash."""
    sample = (
        documents.select(F.col(text).substr(1, SAMPLE_CHARS).alias("t"), label_of(F.col(lang)).alias("l"), F.xxhash64(key, text).alias("h"))
        .filter("t is not null and l is not null").orderBy("h", "l").limit(SAMPLE_TEXTS).toPandas()
    )
    return [(s, LANGS.index(l)) for t, l in zip(sample["t"], sample["l"]) for _, _, s in sentences(t) if len(s) > 12][:SAMPLE_SENTENCES]


def fit(got: list[tuple[str, int]]) -> ByteNet:
    texts, y = [s for s, _ in got], np.array([k for _, k in got])
    rng = np.random.default_rng(3)
    # some sentences lose their accents, or are broken off, as some texts do
    texts = [_stripped(s) if r < 0.12 else s[: int(len(s) * 0.5) + 8] if r > 0.9 else s for s, r in zip(texts, rng.random(len(texts)))]
    x, owner = windows(texts)
    net = ByteNet()
    net.train(x, y[owner], 2, rate=6e-3)
    for seed, rate, least in ((2, 5e-3, 0.1), (3, 4e-3, 0.2)):  # labels that the network all but rules out are taken for wrong
        keep = (net.sentence_scores(texts)[np.arange(len(y)), y] > np.log(least))[owner]
        net.train(x[keep], y[owner][keep], 2, rate=rate, seed=seed)
    return net


def train_network(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folder: str | None = None) -> ByteNet | None:
    """The network of the bounded sample: read from the shared folder if it was trained on before, else trained and written there."""
    import hashlib

    got = training_sample(documents, key, text, lang)
    if not got:
        return None
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    settings = (LANGS, WINDOW, EMBED, FILTERS, WIDTHS, DROPOUT)
    name = hashlib.sha256(repr((settings, got)).encode("utf-8", "surrogatepass")).hexdigest()[:24]
    where = f"{folder or spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/byte-network-{name}"
    try:
        stored = {r["name"]: np.frombuffer(r["weights"], "float32").reshape(r["shape"]).copy() for r in spark.read.parquet(where).collect()}
    except AnalysisException:  # not there
        stored = {}
    net = ByteNet()
    if stored.keys() == net.p.keys():
        net.p = stored
        return net
    net = fit(got)
    rows = [(k, list(v.shape), v.astype("float32").tobytes()) for k, v in net.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, weights binary").coalesce(1).write.mode("overwrite").parquet(where)
    return net


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language of each sentence in a row, a change costing the penalty."""
    n = len(scores)
    back, total = np.zeros(scores.shape, int), scores[0].copy()
    for k in range(1, n):
        change = total.max() - penalty
        stay = total >= change
        back[k] = np.where(stay, np.arange(scores.shape[1]), total.argmax())
        total = np.where(stay, total, change) + scores[k]
    path = np.empty(n, int)
    path[-1] = total.argmax()
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def segments_of(texts: list[str | None], net: ByteNet) -> list[list[tuple[int, str, float, int, int]]]:
    """Per text its segments: number, language, confidence, first and last character."""
    cut = [sentences(t) if t else [] for t in texts]
    flat = [s for one in cut for _, _, s in one]
    if not flat:
        return [[] for _ in texts]
    distinct = sorted(set(flat), key=len)
    at = {s: i for i, s in enumerate(distinct)}
    scores = net.sentence_scores(distinct)
    weight = np.array([min(3.0, len(s) / 10) for s in distinct])  # a word or two can't outweigh its neighbours
    out = []
    for one in cut:
        rows = [at[s] for _, _, s in one]
        if not rows:
            out.append([])
            continue
        path = best_path(scores[rows] * weight[rows][:, None])
        found, first = [], 0
        for k in range(1, len(path) + 1):
            if k == len(path) or path[k] != path[first]:
                p = float(np.exp(scores[rows[first:k]][:, path[first]]).mean())
                found.append((len(found) + 1, LANGS[path[first]], p, one[first][0], one[k - 1][1]))
                first = k
        out.append(found)
    return out


def language_segments(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", net: ByteNet | None = None) -> DataFrame:
    """key, label (language the given label names), seg_no, seg_count, lang, confidence, start_char, end_char and outcome."""
    net = net or train_network(documents, key, text, lang)
    key_type = dict(documents.dtypes)[key]
    schema = f"{key} {key_type}, label string, seg_no long, seg_count long, lang string, confidence double, start_char long, end_char long, outcome string"
    rows = documents.select(F.col(key), F.col(text).alias("t"), label_of(F.col(lang)).alias("label"))
    if net is None:
        return documents.sparkSession.createDataFrame([], schema)
    weights = net.p

    def classify(batches):
        model = ByteNet()
        model.p = weights
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                out = [
                    (k, label, no, len(segs), code, p, a, b, code if p >= SURE else "other")
                    for k, label, segs in zip(part[key], part["label"], segments_of(part["t"].tolist(), model)) for no, code, p, a, b in segs
                ]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(classify, schema)


def mislabelled(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments of the texts whose label names no or another language, or that hold several languages."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("seg_count") > 1)
    return segments.filter(wrong).select(key, "seg_no", "lang")
