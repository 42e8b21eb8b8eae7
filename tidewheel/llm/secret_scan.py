"""Secret scans: rule matches, plus character Markov models of random strings against ordinary identifiers.

Two first-order character models are trained from labelled samples, one on random strings and one on what is
written on purpose: identifiers, paths, long words, numbers, ruled lines. A run of key characters of MIN_RUN or more,
or what base spans leave of one, is reported as ``markov`` if its mean log-likelihood ratio reaches a threshold that falls with its
length. Of a run that does not, as of a key in a path, the stretches are reported whose ratios alone add up to as much. Beside that least length nothing but the ratio decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, id_and_text

KINDS = ("assign", "access", "hex", "markov")
# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Same leftmost runs as HEX and ACCESS with their lengths checked after, but found without a match for each letter.
HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
ACCESS_RUN = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
MIN_RUN = 16
KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: What parts the words of paths, addresses and names; a stretch within a run is widened to the next of them.
MARKS = "/_=+-"
WORD = re.compile("[^/_=+-]+")
#: A run of n characters is random from a mean log ratio (natural logarithm, a character) of MIN_RATIO + MORE / n on.
MIN_RATIO, MORE = 0.45, 8.0

_PARTS = (
    "account action address admin alert analysis array asset author backup balance batch binary bucket buffer build button cache "
    "calendar callback category channel chapter client cluster column command comment common config connection content context "
    "counter country create cursor custom daily data database default delete detail device display document domain download editor "
    "element email encoder engine entry error event example export field figure file filter folder format function gateway global "
    "group handler header helper history image import index input item journal kernel label language latest layout length library "
    "license list loader local location logger manager market master memory message method metric model module monitor name network "
    "node number object offset option order output package page panel parser partition path pattern payload people pipeline"
).split()
_WORDS = (
    "and the that with from have this will your which their about would there could other after first never where right think "
    "being under might while every through between because against without something understanding development information "
    "und nicht eine sich auch werden haben einer durch gegen zwischen menschen schlecht freundlichkeit geschichte verbindung "
    "gesellschaft entwicklung moeglichkeit wissenschaft "
    "les des une dans pour avec sur plus tout comme mais leur bien sans peut entre toujours quelque maintenant gouvernement "
    "developpement connaissance rapidement "
    "los las una para con por como pero mas todo esta entre cuando muy sin sobre tambien hasta desde nosotros gobierno "
    "informacion rapidamente conocimiento"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, is_random), n of each by rule.

    Random: digests in six spellings, of 16 characters to 40. Ordinary: names joined from common words in five ways, two to five words of
    four languages run together, numbers and dates, one sign again and again.
    """
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample "), i.cast("string")), 512)
    base64 = F.base64(F.unhex(digest))
    plain = F.translate(base64, "+/=", "")
    spelled = (
        F.when(i % 6 == 0, F.substring(digest, 1, 40)).when(i % 6 == 1, F.upper(F.substring(digest, 1, 32))).when(i % 6 == 2, F.substring(base64, 1, 40))
        .when(i % 6 == 3, F.substring(plain, 5, 24)).when(i % 6 == 4, F.substring(F.translate(plain, "0123456789", ""), 3, 20)).otherwise(F.substring(F.lower(plain), 9, 16))
    )
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10)
    words, parts = F.array(*map(F.lit, _WORDS)), F.array(*map(F.lit, _PARTS))
    pick = lambda k, own=parts, n=len(_PARTS): F.element_at(own, (number(1 + 8 * k, 7).cast("long") % n + 1).cast("int"))
    word = lambda k: pick(k, words, len(_WORDS))
    together = F.array_join(F.slice(F.array(*(word(k) for k in range(5))), 1, (i % 4 + 2).cast("int")), "")
    signs = ALPHABET + "=-_" * 10
    sign = F.element_at(F.array(*map(F.lit, signs)), (i % len(signs) + 1).cast("int"))
    name = (
        F.when(i % 9 == 0, F.concat_ws("_", pick(0), pick(1), pick(2), number(60, 3)))
        .when(i % 9 == 1, F.concat(pick(0), F.initcap(pick(1)), F.initcap(pick(2)), number(60, 3)))
        .when(i % 9 == 2, F.concat_ws("/", pick(0), pick(1), F.concat(pick(2), F.lit("-"), number(60, 3))))
        .when(i % 9 == 3, F.upper(F.concat_ws("_", pick(0), pick(1), pick(2))))
        .when(i % 9 == 4, F.concat_ws("-", F.lit("2024"), F.lpad(number(60, 3), 4, "0"), pick(0), pick(1)))
        .when(i % 9 == 5, F.initcap(together)).when(i % 9 == 6, together)
        .when(i % 9 == 7, F.concat_ws("-", number(1, 7), number(9, 7), F.substring(number(17, 7), 1, 4)))
        .otherwise(F.repeat(sign, 20))
    )
    ids = spark.range(0, n, 1, 1)
    return ids.select(spelled.alias("text"), F.lit(True).alias("is_random")).unionAll(ids.select(name.alias("text"), F.lit(False).alias("is_random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """Log ratio of the transition from one character to the next, random over ordinary.

    Row 0 stands for the start. A square of the alphabet's size whatever the number of samples, so it
    may be gathered. Null texts and characters outside the alphabet count for nothing.
    """
    text = F.col("text")
    at = F.explode(F.sequence(F.lit(1), F.length(text)))
    pairs = (
        samples.where(F.length(text) > 0).select("is_random", text, at.alias("i"))
        .select("is_random", F.when(F.col("i") == 1, "").otherwise(F.expr("substring(text, i - 1, 1)")).alias("a"), F.expr("substring(text, i, 1)").alias("b"))
        .groupBy("is_random", "a", "b").count().collect()
    )
    size = len(ALPHABET) + 1
    code = {c: k + 1 for k, c in enumerate(ALPHABET)} | {"": 0}
    n = np.full((2, size, size), smoothing)
    for r in pairs:
        if r["a"] in code and r["b"] in code:
            n[int(bool(r["is_random"])), code[r["a"]], code[r["b"]]] += r["count"]
    p = np.log(n[:, :, 1:] / n[:, :, 1:].sum(axis=2, keepdims=True))
    out = np.zeros((size, size))
    out[:, 1:] = p[1] - p[0]
    return out


_CODE = np.zeros(256, np.int64)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k + 1


def ratio(run: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio for each character of a run of ALPHABET."""
    codes = _CODE[np.frombuffer(run.encode("latin-1"), np.uint8)]
    return float(model[np.concatenate(([0], codes[:-1])), codes].mean())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules; kinds by their place in KINDS, so sorting gives the contract's order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS_RUN.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(found)


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans (by start) leave of start..end."""
    for a, _, e in base:
        if a >= end:
            break
        if a > start:
            yield start, a
        start = max(start, e)
    if start < end:
        yield start, end


def stretches(run: str, model: np.ndarray, least: float = MIN_RATIO) -> list[tuple[int, int]]:
    """Stretches of a run whose log ratios exceed `least` a character by MORE in sum, each widened to the marks around it, in one pass.

    A sum starts anew where it falls below 0. A stretch ends at its peak, once the sum has fallen MORE below it. Where a widened stretch is under MIN_RUN or no longer
    reaches MORE, the words in it that do by themselves count; so a word with a few rare letters goes.
    """
    codes = _CODE[np.frombuffer(run.encode("latin-1"), np.uint8)]
    gains = model[np.concatenate(([0], codes[:-1])), codes] - least
    sums = np.concatenate(([0], np.cumsum(gains)))
    if (sums - np.minimum.accumulate(sums)).max() < MORE:
        return []
    found, start, end, total, peak = [], 0, 0, 0.0, 0.0
    for i, gain in enumerate([*gains.tolist(), -np.inf]):
        total += gain
        if total > peak:
            peak, end = total, i + 1
        if total < 0 or peak - total >= MORE:
            if peak >= MORE:
                found.append((start, end))
            start, total, peak = i + 1, 0.0, 0.0
    wide: list[tuple[int, int]] = []
    for a, e in found:
        floor = wide[-1][1] if wide else 0
        while a > floor and run[a - 1] not in MARKS:
            a -= 1
        while e < len(run) and run[e] not in MARKS:
            e += 1
        if a < floor:  # within the word that the stretch before was widened to
            a = floor
        words = [(a, e), *((a + m.start(), a + m.end()) for m in WORD.finditer(run[a:e]))]
        enough = [(x, y) for x, y in words if y - x >= MIN_RUN and sums[y] - sums[x] >= MORE]
        wide += enough[:1] if enough and enough[0] == (a, e) else enough
    return wide


def markov_spans(text: str, base: list[tuple[int, int, int]], model: np.ndarray, least: float = MIN_RATIO) -> list[tuple[int, int, int]]:
    """Runs, or what base spans leave of them, that the models call random; of others their random stretches."""
    found = []
    for m in KEY_RUN.finditer(text):
        for a, e in outside(m.start(), m.end(), base):
            if e - a < MIN_RUN:
                continue
            if ratio(text[a:e], model) >= least + MORE / (e - a):
                found.append((a, 3, e))
            else:
                found += [(a + x, 3, a + y) for x, y in stretches(text[a:e], model, least)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, is_base>>), a row for each input row, spans by start, then kind.

    Null and empty texts have no spans; repeated rows and null ids are kept as they come; an empty table
    gives an empty table; other columns are not looked at.
    """
    lr = train(labelled_samples(docs.sparkSession)) if model is None else model

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("is_base", pa.bool_())]))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                every = sorted(base + markov_spans(text or "", base, lr, min_ratio))
                rows.append([{"kind": KINDS[k], "start": a, "end": e, "is_base": k < 3} for a, k, e in every])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return by_batch(id_and_text(docs, id_col, text_col), spans, "doc_id long, spans array<struct<kind:string,start:long,end:long,is_base:boolean>>")


def redacted(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """docs with every span replaced by a mark; overlapping spans become one. Null texts stay null."""
    lr = train(labelled_samples(docs.sparkSession)) if model is None else model
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                every = sorted(base + markov_spans(text, base, lr))
                if every:
                    out, end = [], 0
                    for a, _, e in every:
                        if a >= end:
                            out += [text[end:a], mark]
                        end = max(end, e)
                    texts[i] = "".join(out) + text[end:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(clean, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["is_base"]), text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), n("markov"),
    )


def sha256_of_spans(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
