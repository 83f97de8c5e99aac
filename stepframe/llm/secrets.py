"""Secret scans: base patterns, and a character convolutional network over every candidate (operator 3)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# The base kinds in the order in which ties of a start are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the network looks at besides base findings: long runs of key characters with a letter and a digit, and what a word
#: announces, with or without them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
ANNOUNCED = re.compile(r"""(?ai)(?:key|pwd|pass|auth|credentials?|bearer)["']?(?:\x20*[:=]\x20*|(?<=bearer)\x20+)["']?([A-Za-z0-9+/_=.-]{8,})""")
ANNOUNCERS = ("key", "pwd", "pass", "auth", "credential", "bearer")

LEFT, BODY, RIGHT = 32, 64, 16
LENGTH = LEFT + BODY + RIGHT


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, (kind, start, end) in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    # A run of 24 or more contains a whole match exactly if the maximal run does.
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list) -> list:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def _clear(runs: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that overlap no span and no run before them; in one pass over both in order."""
    out, spans, at, far, last = [], sorted(spans), 0, 0, 0
    for start, end in sorted(runs):
        # The farthest end of the spans that begin before the run's end says if one reaches into it.
        while at < len(spans) and spans[at][0] < end:
            far = max(far, spans[at][1])
            at += 1
        if start >= last and far <= start:
            out.append((start, end))
            last = end
    return out


def candidates(text: str, base: list) -> list[tuple[int, int, bool]]:
    """(start, end, announced) of the values that the network judges, by start: those that a word announces, and other runs of key
    characters that hold a letter and a digit. None touches a base span; dots at an end don't belong to a value."""
    low, spans, told = text.lower(), [(a, b) for _, a, b in base], []
    if any(w in low for w in ANNOUNCERS):
        told = _clear([(a, b) for m in ANNOUNCED.finditer(text) if (b := (a := m.start(1)) + len(m[1].rstrip("."))) - a >= 8], spans)
    runs = []
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".")
        if len(s) >= 16 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            runs.append((m.start(), m.start() + len(s)))
    return sorted([(a, b, True) for a, b in told] + [(a, b, False) for a, b in _clear(runs, spans + told)])


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character ids of a value (its first ``BODY`` characters if it is longer, see ``windows``) and of what surrounds it."""
    body = text[start : min(end, start + BODY)]
    s = text[max(0, start - LEFT) : start].rjust(LEFT, "\x00") + body.ljust(BODY, "\x00") + text[end : end + RIGHT].ljust(RIGHT, "\x00")
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 30, 1)).astype(np.uint8)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Windows that cover a value whole: one, or for a long value one for each ``BODY`` characters, the last up to its end."""
    if end - start <= BODY:
        return [window(text, start, end)]
    return [window(text, a, min(a + BODY, end)) for a in [*range(start, end - BODY, BODY), end - BODY]]


class CharCnn:
    """Embedding, one convolution, maximum and mean over positions inside and outside the candidate, logistic output."""

    WIDTH, DIM, FILTERS, VOCAB = 5, 10, 24, 98

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (self.VOCAB, self.DIM)).astype(np.float32)
        self.conv = r.normal(0, (2 / (self.WIDTH * self.DIM)) ** 0.5, (self.WIDTH * self.DIM, self.FILTERS)).astype(np.float32)
        self.bias = np.zeros(self.FILTERS, np.float32)
        self.out = np.zeros(4 * self.FILTERS + 1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        #: Thresholds of announced and of other values.
        self.thresholds = {True: 0.5, False: 0.5}

    def _parts(self):
        return [self.embed, self.conv, self.bias, self.out]

    def _forward(self, x: np.ndarray):
        n, steps = len(x), LENGTH - self.WIDTH + 1
        e = self.embed[x]
        cols = np.concatenate([e[:, i : i + steps] for i in range(self.WIDTH)], axis=2)
        z = cols.reshape(-1, cols.shape[2]) @ self.conv + self.bias
        a = np.maximum(z, 0).reshape(n, steps, self.FILTERS)
        inner = slice(LEFT, LEFT + BODY - self.WIDTH + 1)
        outer = a[:, :LEFT]
        top_in, top_out = a[:, inner].argmax(1), outer.argmax(1)
        rows, f = np.arange(n)[:, None], np.arange(self.FILTERS)[None]
        feats = np.concatenate([a[:, inner][rows, top_in, f], outer[rows, top_out, f], a[:, inner].mean(1), outer.mean(1), np.ones((n, 1), np.float32)], axis=1)
        return cols, a, top_in + LEFT, top_out, feats, feats @ self.out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by the logistic fit on held-out findings."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.004, seed: int = 1) -> None:
        r, first, second, t = np.random.default_rng(seed), [np.zeros_like(p) for p in self._parts()], [np.zeros_like(p) for p in self._parts()], 0
        steps = LENGTH - self.WIDTH + 1
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(order), 64):
                own = order[at : at + 64]
                xb, n = x[own], len(own)
                cols, a, top_in, top_out, feats, z = self._forward(xb)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]).astype(np.float32) / n
                g_out = feats.T @ d
                back = d[:, None] * self.out[None]
                k, inner = self.FILTERS, BODY - self.WIDTH + 1
                da = np.zeros_like(a)
                da[:, LEFT : LEFT + inner] = back[:, None, 2 * k : 3 * k] / inner
                da[:, :LEFT] += back[:, None, 3 * k : 4 * k] / LEFT
                rows, f = np.arange(n)[:, None], np.arange(k)[None]
                da[rows, top_in, f] += back[:, :k]
                da[rows, top_out, f] += back[:, k : 2 * k]
                da = (da * (a > 0)).reshape(-1, k)
                g_conv, g_bias = cols.reshape(-1, cols.shape[2]).T @ da, da.sum(0)
                dc = (da @ self.conv.T).reshape(n, steps, self.WIDTH, self.DIM)
                de = np.zeros((n, LENGTH, self.DIM), np.float32)
                for i in range(self.WIDTH):
                    de[:, i : i + steps] += dc[:, :, i]
                hot = np.zeros((self.VOCAB, self.DIM), np.float32)
                np.add.at(hot, xb.ravel(), de.reshape(-1, self.DIM))
                t += 1
                for p, g, m, v in zip(self._parts(), (hot, g_conv, g_bias, g_out), first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Logistic scaling on held-out findings, then the highest threshold that keeps the recall asked for."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, [((y - p) * z).sum() - 1e-3 * a, (y - p).sum()])
            a, b = a + step[0], b + step[1]
        self.scale, self.shift = float(a), float(b)
        self.threshold = self._lowest(x[y == 1], recall)
        self.thresholds = {True: self.threshold, False: self.threshold}

    def _lowest(self, x: np.ndarray, recall: float) -> float:
        scores = np.sort(self.probability(x))
        return float(scores[int((1 - recall) * len(scores))]) if len(scores) else 1.0

    def calibrate_kinds(self, x: np.ndarray, y: np.ndarray, recall: float, announced: np.ndarray) -> None:
        """The threshold that keeps the recall, of announced values and of others by themselves, where held-out ones are there."""
        for kind in (True, False):
            own = x[(y == 1) & (announced == kind)]
            if len(own):
                self.thresholds[kind] = self._lowest(own, recall)


def text_findings(text: str) -> list[tuple[np.ndarray, int]]:
    """Labelled windows of a text: values of base findings (1). Other candidates have no label, as they may be secrets."""
    return [(window(text, a + (ASSIGN.match(text, a).start(2) - a if kind == "assign" else 0), b), 1) for kind, a, b in base_spans(text)]


def corpus_findings(docs: DataFrame, sample_docs: int, per_doc: int = 500) -> tuple[list[tuple[np.ndarray, int]], list[str]]:
    """Labelled windows, and a passage, of each of the ``sample_docs`` documents of least id hash (whole texts);
    at most ``per_doc`` windows of a document.

    Only windows of 112 characters and passages of 200 go to the driver.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id", order.alias("o")).distinct().orderBy("o", "doc_id").limit(sample_docs).collect()]
    if not ids:
        return [], []

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                at = (doc * 7919) % max(1, len(text) - 200)
                rows.append((doc, text[at : at + 200], None, None))
                rows += [(doc, None, x.tobytes(), y) for x, y in text_findings(text)[:per_doc]]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.int32()))], names=["doc_id", "passage", "window", "label"])

    rows = docs.where(F.col("doc_id").isin(ids)).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, passage string, window binary, label int").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.passage or "", bytes(r.window or b"")))
    return [(np.frombuffer(bytes(r.window), np.uint8), r.label) for r in rows if r.window is not None], [r.passage for r in rows if r.passage]


#: Kinds of made secrets; announced ones may also be short or without digits.
SECRETS = ("mixed", "lower", "prefixed", "dashed", "encoded", "dotted", "letters", "short")


def made_findings(passages: list[str], count: int = 3000, seed: int = 7, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[np.ndarray, int]]:
    """Labelled windows of made findings between words of ``passages``; a label follows from what was made.

    Positive, of the ``SECRETS`` that ``without`` and ``only`` leave: keys, prefixed and dotted tokens, encoded secrets, most after words
    that announce one. Negative: numbered words, time stamps, UUIDs, paths, host names, versions, long identifiers, and
    plain words, some after the same announcing words.
    """
    return [(x, y) for x, y, _, _ in _made_kinds(passages, count, seed, without, only)]


def _made(passages: list[str], count: int = 3000, seed: int = 7) -> list[tuple[np.ndarray, int, bool]]:
    """Made findings, and whether base patterns find them anyway."""
    return [m[:3] for m in _made_kinds(passages, count, seed)]


def _made_kinds(passages: list[str], count: int = 3000, seed: int = 7, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[np.ndarray, int, bool, bool]]:
    """The same, and whether a word announces them."""
    r, out = np.random.default_rng(seed), []
    words = [w.strip(".,") for t in passages for w in t.split()] or ["some", "text"]
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def chars(s, n):
        return "".join(s[i] for i in r.integers(0, len(s), n))

    def some(n):
        return " ".join(words[i] for i in r.integers(0, len(words), n))

    def emit(before, value, label):
        text = f"{some(6)} {before}"
        whole = f"{text}{value} {some(4)}"
        start, end = len(text), len(text) + len(value)
        base = base_spans(whole)
        told = any(a == start and announced for a, _, announced in candidates(whole, []))
        out.append((window(whole, start, end), label, any(a < end and start < b for _, a, b in base), told))

    every = low + up + digit
    secret = {
        "mixed": lambda: chars(every, int(r.integers(20, 48))), "lower": lambda: chars(low + digit, int(r.integers(20, 48))), "prefixed": lambda: "ghp_" + chars(every, 36), "dashed": lambda: "sk-" + chars(every, 40),
        "encoded": lambda: chars(every + "+/", 40) + "==", "dotted": lambda: ".".join(chars(every + "-_", int(n)) for n in r.integers(12, 28, 2 + int(r.integers(0, 2)))),
        "letters": lambda: chars(low if r.random() < 0.5 else low + up, int(r.integers(18, 32))), "short": lambda: chars(every + "+/", int(r.integers(10, 16))),
    }
    kinds = [k for k in SECRETS if k not in without and (not only or k in only)]
    lead = ("key = ", "auth: ", "credential=", "Authorization: Bearer ", "private_key: ", "key=", "pwd: ", "credentials: ", "pass=", "Bearer ")
    open_lead = ("", "see ", "page ", "id: ", "the ", "on ")
    plain = (lambda: some(3).replace(" ", "") + chars(digit, 2), lambda: f"{chars(digit, 4)}-{chars(digit, 2)}-{chars(digit, 2)}T{chars(digit, 6)}Z", lambda: "-".join(chars("abcdef" + digit, n) for n in (8, 4, 4, 4, 12)), lambda: "/" + "/".join(some(1) for _ in range(4)) + chars(digit, 1), lambda: f"chapter_{some(1)}_{some(1)}_{chars(digit, 2)}", lambda: f"www.{some(1)}.{some(1)}.example{chars(digit, 1)}.org/{some(1)}", lambda: f"v{chars(digit, 1)}.{chars(digit, 2)}.{chars(digit, 1)}-{some(1)}.{chars(digit, 4)}")
    for i in range(count // 2):
        kind = kinds[i % len(kinds)]
        emit(lead[int(r.integers(0, len(lead)))] if kind in ("letters", "short") or i % 4 else "", secret[kind](), 1)
        # Plain words, a few joined, stand after announcing words as often as secrets do.
        if i % 3 == 0:
            emit(lead[int(r.integers(0, len(lead)))], some(1 + int(r.integers(0, 3))).replace(" ", "_-."[int(r.integers(0, 3))]).ljust(8, "e"), 0)
        else:
            emit(open_lead[i % len(open_lead)], plain[i % len(plain)]().ljust(16, "x"), 0)
    return out


def train(findings: list[tuple[np.ndarray, int]], recall: float = 0.95, seed: int = 0, base: list[tuple[np.ndarray, int]] | None = None, announced: list[bool] | None = None) -> CharCnn:
    """Fit on two thirds of labelled findings, calibrate and set the thresholds on the rest. Findings of ``base``, which
    stay whatever their score, are only fitted."""
    x, y = np.stack([f[0] for f in findings]), np.array([f[1] for f in findings])
    held = np.random.default_rng(3).random(len(x)) < 1 / 3
    model = CharCnn(seed)
    more = [f[0] for f in base or []], [f[1] for f in base or []]
    model.fit(np.stack([*x[~held], *more[0]]), np.concatenate([y[~held], np.array(more[1], y.dtype)]))
    model.calibrate(x[held], y[held], recall)
    if announced is not None:
        model.calibrate_kinds(x[held], y[held], recall, np.array(announced)[held])
    return model


def trained_on(docs: DataFrame, sample_docs: int = 2000, recall: float = 0.95, per_doc: int = 500) -> CharCnn:
    """A model from labelled findings of at most ``sample_docs`` documents, ``per_doc`` of each, and made ones."""
    found, passages = corpus_findings(docs, sample_docs, per_doc)
    made = _made_kinds(passages)
    return train([(x, y) for x, y, known, _ in made if not known], recall, base=found + [(x, y) for x, y, known, _ in made if known], announced=[told for _, _, known, told in made if not known])


def scan_text(text: str, model: CharCnn) -> list[tuple[str, int, int, float]]:
    """All findings of a text: (kind, start, end, probability)."""
    return scan_texts([text], model)[0]


def scan_texts(texts: list, model: CharCnn) -> list[list[tuple[str, int, int, float]]]:
    out, x, at = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        for kind, a, b in base:
            x.append(window(text, a + (ASSIGN.match(text, a).start(2) - a if kind == "assign" else 0), b))
            at.append((i, kind, a, b))
        for a, b, announced in candidates(text, base):
            parts = windows(text, a, b)
            x += parts
            at += [(i, ("model", announced), a, b)] * len(parts)
        out.append([])
    best: dict[tuple, float] = {}
    for found, p in zip(at, model.probability(np.stack(x)) if x else []):
        # A long value is as likely as its likeliest part.
        best[found] = max(best.get(found, 0.0), float(p))
    for (i, kind, a, b), p in best.items():
        if isinstance(kind, str):
            out[i].append((kind, a, b, p))
        elif p >= model.thresholds[kind[1]]:
            out[i].append((kind[0], a, b, p))
    return [ordered(f) for f in out]


FINDINGS = "array<struct<kind:string,start:int,end:int,probability:double>>"


def scan(docs: DataFrame, model: CharCnn) -> DataFrame:
    """Adds ``findings`` to each row: (kind, start, end, probability), code points, end exclusive, by start and kind.

    Base findings always stay; the network adds candidates whose calibrated probability reaches its threshold, as kind
    ``model``. Row by row, no shuffle. Null texts are empty and have no findings; repeated rows each get theirs; an
    existing column ``findings`` is replaced; other columns pass through; an empty table gives no rows.
    """
    docs = docs.drop("findings")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = scan_texts(batch.column("text").to_pylist(), sent.value)
            rows = [[{"kind": k, "start": a, "end": b, "probability": p} for k, a, b, p in f] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*names, "findings"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("findings", T._parse_datatype_string(FINDINGS))]))


def redact(docs: DataFrame, model: CharCnn, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with each finding's characters replaced by ``mark`` (overlapping findings by one); same columns.

    ``n_chars``, where present, is the new length. Null texts stay null, repeated rows repeated; an empty table stays empty.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, scan_texts(texts.tolist(), sent.value)):
            if found:
                parts, at = [], 0
                for _, a, b, _ in found:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    def line(x):
        return F.concat_ws(",", F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def op3_secret_scans(spark: SparkSession, sf_dir: str, sample_docs: int = 2000) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, trained_on(docs, sample_docs))
    return digest(found.select("doc_id", "findings"))
