"""The language of texts and of the segments of texts in several languages, with a confidence.

A convolutional network over bytes: filters of several widths, max pooling over the window and a softmax, trained in
numpy on labelled text. Texts are cut into sentences, sentences into windows of fixed length, and windows are classified
in batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.batches import bounded

UND = "und"
WINDOW, STRIDE = 96, 64
DIM, WIDTHS, FILTERS = 12, (2, 3, 4), (32, 48, 64)
#: At most so many labelled rows of each language are used for training.
TRAIN_ROWS = 400
#: At most so many rows of each language whose label can be wrong are read beside them.
CLAIMED_ROWS = 3000
#: The other sentences of a text count as so much evidence for one of which the network is unsure.
CONTEXT = 0.5

_NOISE = re.compile(
    r"\[[^\]\n]*\]\([^)\s]*\)|https?://\S+|www\.\S+|\(see /r/\w+\)|/?\b[ur]/[\w-]+|\[ref \w+\]|&\w+;|&#\d+;|#\w+|```.*?```", re.I | re.S
)
_END = re.compile(r"(?i:\b(?:lol|lmao|ha(?:ha)+|smh)\b)[\s.!]*|(?<=[.!?…])[\"')\]»”]*\s+|\n+|(?<=[。！？])|[\U0001F000-\U0001FAFF☀-➿️‍]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
#: Cyrillic letters that look like Latin ones (fixed values), folded in words that mix the two scripts.
_LOOKALIKE = str.maketrans("аеорсухікмнтвАЕОРСУХІКМНТВ", "aeopcyxikmhtbAEOPCYXIKMHTB")
_MIXED = re.compile(r"\b(?=\w*[a-zA-Z])(?=\w*[а-яіА-ЯІ])\w+")


_PLAIN_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")


def quiet(text: str) -> str:
    """The text without links, mentions, tags and code."""
    if "[" in text or "/" in text or "&" in text or "#" in text or "`" in text or "www." in text.lower():
        return _NOISE.sub(" ", text)
    return text


def _is_plain(text: str) -> bool:
    """Whether only stops and line ends can end a sentence of the text."""
    if not text.isascii():
        return False
    low = text.lower()
    return not ("lol" in low or "lmao" in low or "haha" in low or "smh" in low)


def parts(text: str) -> list[str]:
    """What stands between the sentence ends of a text without noise. Laughter is one too. Plain texts take a shorter pattern."""
    return (_PLAIN_END if _is_plain(text) else _END).split(text)


def counted(quiet_text: str) -> tuple[int, list[tuple[str, int]]]:
    """The words of a text, and its sentences of two words at least with theirs. Words of laughter belong to no sentence."""
    plain, total, out = _is_plain(quiet_text), 0, []
    for s in (_PLAIN_END if plain else _END).split(quiet_text):
        if s:
            n = len(_WORD.findall(s))
            total += n
            if n >= 2:
                out.append((" ".join(s.split()), n))
    return total if plain else len(_WORD.findall(quiet_text)), out


def sentences(text: str) -> list[str]:
    """The sentences of a text without links, mentions, tags and code, each with two words at least. Laughter ends one too."""
    return [s for s, _ in counted(quiet(text))[1]]


def n_words(text: str) -> int:
    """Words aside from links, mentions and numbers."""
    return len(_WORD.findall(quiet(text)))


def windows(sentence: str) -> list[bytes]:
    if not sentence.isascii():
        sentence = _MIXED.sub(lambda m: m.group().translate(_LOOKALIKE), sentence)
    raw = sentence.lower().encode().translate(_DIGITS)
    if len(raw) <= WINDOW:
        return [raw]
    last = len(raw) - WINDOW
    return [raw[i : i + WINDOW] for i in [*range(0, last, STRIDE), last]]


def matrix(rows: list[bytes], length: int = WINDOW) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(length, b"\0") for r in rows), np.uint8).reshape(len(rows), length)


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    embed: np.ndarray  # 256 x DIM
    conv: np.ndarray  # max(WIDTHS) * DIM x sum(FILTERS), zero where a filter is narrower
    bias: np.ndarray
    out: np.ndarray  # sum(FILTERS) x languages
    out_bias: np.ndarray

    def _columns(self, x: np.ndarray) -> np.ndarray:
        w = max(WIDTHS)
        e = self.embed[x]
        return np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)

    def probabilities(self, rows: list[bytes], batch: int = 64) -> np.ndarray:
        """Windows x languages. Windows of like length are taken together, so that short ones cost less."""
        got = np.zeros((len(rows), len(self.languages)), np.float32)
        order = np.argsort([len(r) for r in rows], kind="stable")
        pad = max(WIDTHS) - 1
        for i in range(0, len(rows), batch):
            at = order[i : i + batch]
            x = matrix([rows[j] for j in at], max(len(rows[at[-1]]), 1) + pad)
            z = self._columns(x)
            n, t, c = z.shape
            h = np.maximum((z.reshape(n * t, c) @ self.conv).reshape(n, t, -1).max(axis=1) + self.bias, 0)
            s = h @ self.out + self.out_bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            got[at] = s / s.sum(axis=1, keepdims=True)
        return got


def _initial(languages: tuple[str, ...], rng: np.random.Generator) -> Network:
    f, w = sum(FILTERS), max(WIDTHS)
    embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
    embed[0] = 0
    conv = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, f)).astype(np.float32) * _mask()
    out = rng.normal(0, f**-0.5, (f, len(languages))).astype(np.float32)
    return Network(languages, embed, conv, np.zeros(f, np.float32), out, np.zeros(len(languages), np.float32))


def _mask() -> np.ndarray:
    m = np.zeros((max(WIDTHS) * DIM, sum(FILTERS)), np.float32)
    at = 0
    for w, f in zip(WIDTHS, FILTERS, strict=True):
        m[: w * DIM, at : at + f] = 1
        at += f
    return m


def _fit(net: Network, rows: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 3e-3) -> Network:
    """Adam on the weighted cross entropy."""
    p = [net.embed.copy(), net.conv.copy(), net.bias.copy(), net.out.copy(), net.out_bias.copy()]
    m, v, mask, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], _mask(), 0
    x_all, w = matrix(rows, WINDOW + max(WIDTHS) - 1), max(WIDTHS)
    steps = epochs * -(-len(rows) // 64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), 64):
            at = order[i : i + 64]
            x, n = x_all[at], len(at)
            e = p[0][x]
            z = np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)
            t, c = z.shape[1:]
            conv = (z.reshape(n * t, c) @ p[1]).reshape(n, t, -1)
            best = conv.argmax(axis=1)
            pre = np.take_along_axis(conv, best[:, None], 1)[:, 0] + p[2]
            keep = rng.random(pre.shape) < 0.8
            h = np.maximum(pre, 0) * keep / 0.8
            s = h @ p[3] + p[4]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            g = s
            g[np.arange(n), labels[at]] -= 1
            g *= weights[at, None] / n
            dh = (g @ p[3].T) * keep / 0.8 * (pre > 0)
            f = dh.shape[1]
            taken = z[np.arange(n)[:, None], best]  # n x f x c, the input of each pooled filter
            dconv = np.einsum("nfc,nf->cf", taken, dh, optimize=True) * mask
            dz = (dh[:, :, None] * p[1].T[None]).reshape(n, f, w, DIM)
            dembed = np.zeros_like(p[0])
            for k in range(w):
                at_byte = x[np.arange(n)[:, None], best + k].ravel()
                for j in range(DIM):
                    dembed[:, j] += np.bincount(at_byte, dz[:, :, k, j].ravel(), 256)
            dembed[0] = 0
            step += 1
            lr = rate * min(1, step / 50) * (1 - step / (steps + 1))
            for j, d in enumerate((dembed, dconv, dh.sum(0), h.T @ g, g.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * d
                v[j] = 0.99 * v[j] + 0.01 * d * d
                p[j] -= (lr * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(net.languages, *[a.astype(np.float32) for a in p])


#: Latin spelling of Cyrillic letters, and the plain spelling of German letters (fixed values).
_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya".split(" "), strict=True))
_GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def plain(text: str, language: str) -> str:
    """The text in ASCII letters, as people write it without the keyboard for its language."""
    if language == "ru":
        return "".join(_LATIN.get(c, c) for c in text.lower())
    if language == "de":
        text = "".join(_GERMAN.get(c, c) for c in text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _typo(s: str, rng: np.random.Generator) -> str:
    c = list(s)
    for _ in range(1 + len(c) // 40):
        i = int(rng.integers(0, max(1, len(c) - 1)))
        if i + 1 < len(c) and rng.random() < 0.5:
            c[i], c[i + 1] = c[i + 1], c[i]
        elif len(c) > 2:
            del c[i]
    return "".join(c)


def _junk(rng: np.random.Generator, vocabulary: list[str]) -> str:
    """No language: invented words and names, and one word over and over."""
    def word() -> str:
        return "".join(rng.choice(list("bdfgjklmnprstvwz")) + rng.choice(list("aeiouy")) + rng.choice(["", "", "n", "r", "st", "lt"]) for _ in range(int(rng.integers(1, 4))))

    kind = rng.random()
    if kind < 0.3:
        return " ".join(word() for _ in range(int(rng.integers(1, 6))))
    one = word() if kind < 0.45 else "".join(rng.choice(vocabulary, int(rng.integers(1, 3))))
    mark = rng.choice([", ", " ", " ", " ", "! "])
    tail = rng.choice(["", "", " lol", " smh", " tbh", " :D", " more"])
    return mark.join(rng.choice([one, one.upper(), one.capitalize()]) for _ in range(int(rng.integers(2, 10)))) + tail


def _varied(lang: str, s: str, copies: int, rng: np.random.Generator) -> list[str]:
    variants = [s]
    for _ in range(copies):
        v = plain(s, lang) if lang != "en" and rng.random() < 0.35 else s
        words = v.split()
        if len(words) > 5 and rng.random() < 0.6:
            n = int(rng.integers(4, len(words)))
            at = int(rng.integers(0, len(words) - n + 1))
            v = " ".join(words[at : at + n])
        variants.append(_typo(v, rng) if rng.random() < 0.4 else v)
    return variants


def _weighted(labels: list[int], classes: int, given: list[float]) -> np.ndarray:
    y = np.array(labels)
    each = len(y) / np.maximum(np.bincount(y, minlength=classes), 1) / classes
    return (np.sqrt(each)[y] * np.array(given)).astype(np.float32)


def train(
    samples: list[tuple[str, str]],
    claimed: list[tuple[str, str]] = (),
    seed: int = 7,
    epochs: int = 14,
    copies: int = 6,
    more_epochs: int = 10,
) -> Network:
    """A network for the languages of samples (language, text) and one class for what is in none.

    Every sentence is used as it is and in varied form: cut short, with slips, and without its own letters. claimed are
    texts with labels that can be wrong. The network from the samples reads them: sentences of which it is sure in
    another language than the label are left out, those of which it is unsure all join the training, and as many of the
    others.
    """
    rng = np.random.default_rng(seed)
    languages = (*sorted({a for a, _ in samples}), UND)
    pairs = [(lang, s) for lang, text in sorted(samples) for s in sentences(text)]
    vocabulary = sorted({w.lower() for _, s in pairs for w in _WORD.findall(s) if len(w) > 2})
    rows: list[bytes] = []
    labels: list[int] = []
    given: list[float] = []

    def add(lang: str, text: str, weight: float = 1.0) -> None:
        w = windows(text)
        rows.extend(w)
        labels.extend([languages.index(lang)] * len(w))
        given.extend([weight] * len(w))

    for lang, s in pairs:
        for v in _varied(lang, s, copies, rng):
            add(lang, v)
    for _ in range(max(50, len(rows) // 8)):
        add(UND, _junk(rng, vocabulary))
    net = _fit(_initial(languages, rng), rows, np.array(labels), _weighted(labels, len(languages), given), epochs, rng)

    weak = [
        (n, lang, s)
        for n, (lang, text) in enumerate(sorted(claimed))
        if lang in languages
        for s in sentences(text)
        if n_words(s) >= 3
    ]
    if not weak:
        return net
    p = net.probabilities([windows(s)[0] for _, _, s in weak])
    top, mine = p.argmax(axis=1), p[np.arange(len(p)), [languages.index(a) for _, a, _ in weak]]
    sure = p.max(axis=1) >= 0.9
    agrees = np.array([languages[t] == a for t, (_, a, _) in zip(top, weak, strict=True)])
    whose = np.array([n for n, _, _ in weak])
    doubted = np.isin(whose, whose[sure & ~agrees])  # texts with a sentence in another language than their label
    unsure = np.flatnonzero(~sure & ~doubted & (mine > 1e-3))
    rest = np.flatnonzero(sure & agrees & ~doubted)
    rest = rng.permutation(rest)[: max(200, len(unsure))]
    for i in (*unsure.tolist(), *rest.tolist()):
        for v in _varied(*weak[i][1:], 2, rng):
            add(weak[i][1], v, 0.7)
    return _fit(net, rows, np.array(labels), _weighted(labels, len(languages), given), more_epochs, rng, 2e-3)


#: Of a longer text so many characters are used for training, from a place that its hash chooses.
SAMPLE_CHARS = 4000


def sample(df: DataFrame, max_rows: int) -> list[tuple[str, str]]:
    """At most max_rows distinct texts of each language of df (lang, text), those with the smallest hashes, of SAMPLE_CHARS at most.

    One pass counts the rows of each language, a second one keeps those below a hash threshold for it. Nothing is sorted,
    and what comes to the driver has a fixed size whatever the size of df.
    """
    known = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for a, n in sorted(sizes.items()) for x in (F.lit(a), F.lit(min(1.0, 1.2 * max_rows / n)))])
    known = known.withColumn("_h", F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    known = known.withColumn("text", F.substring("text", start, F.lit(SAMPLE_CHARS)))
    # one text may stand on many rows; distinct texts below the threshold are as few as it says
    rows = known.where(F.col("_h") <= F.element_at(share, F.col("lang"))).distinct().collect()
    out: dict[str, list[tuple[float, str]]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append((r["_h"], r["text"]))
    return sorted((a, t) for a, x in out.items() for _, t in sorted(x)[:max_rows])


_KEPT: dict[int, Network] = {}


def fit(samples: DataFrame, claimed: DataFrame | None = None, max_rows: int = TRAIN_ROWS, max_claimed: int = CLAIMED_ROWS, **how) -> Network:
    """Train on at most max_rows rows of each language of samples and max_claimed rows of claimed, both (lang, text).

    The labels of samples are taken as right, those of claimed as mostly right. The network is kept for the process.
    """
    pairs = sample(samples, max_rows)
    if len({a for a, _ in pairs}) < 2:
        raise ValueError("labelled text in two languages at least is needed")
    weak = sample(claimed.where(F.col("lang").isin(*{a for a, _ in pairs})), max_claimed) if claimed is not None else []
    key = hash((tuple(pairs), tuple(weak), tuple(sorted(how.items()))))
    if key not in _KEPT:
        _KEPT[key] = train(pairs, weak, **how)
    return _KEPT[key]


#: From this confidence on a window or a sentence is sure of its language.
SURE = 0.9


def _runs(top: list[int], conf: list[float], und: int) -> list[tuple[int, int]]:
    """Windows of a sentence as runs [a, b): a new one begins where, between windows that are sure of two languages, the language changes."""
    cuts, last = [0], None
    for i, (t, c) in enumerate(zip(top, conf, strict=True)):
        if c < SURE or t == und:
            continue
        if last is not None and t != top[last]:
            cuts.append(next(k for k in range(last + 1, i + 1) if top[k] != top[last]))
        last = i
    return list(zip(cuts, [*cuts[1:], len(top)], strict=True))


def _classified(net: Network, texts: list[str | None]) -> tuple[list[int], list[list[tuple[str, str, float, int]]]]:
    """The words of each text, and its segments (language, segment, confidence, words). Equal sentences are read once."""
    languages, und = net.languages, net.languages.index(UND) if UND in net.languages else -1
    number: dict[str, int] = {}
    words, of = [], []
    size: list[int] = []
    for t in texts:
        total, listed = counted(quiet(t)) if t else (0, ())
        words.append(total)
        mine = []
        for s, n in listed:
            i = number.setdefault(s, len(number))
            if i == len(size):
                size.append(n)
            mine.append(i)
        of.append(mine)
    listed = list(number)
    cuts = [windows(s) for s in listed]
    p = net.probabilities([w for c in cuts for w in c])
    top, conf = p.argmax(axis=1).tolist(), p.max(axis=1).tolist() if len(p) else []
    #: of each sentence its pieces: text, words, language, confidence, probabilities
    pieces: list[list[tuple[str, int, int, float, np.ndarray]]] = []
    at = 0
    for s, n, c in zip(listed, size, cuts, strict=True):
        k = len(c)
        if k == 1:
            pieces.append([(s, n, top[at], conf[at], p[at])])
        else:
            runs = _runs(top[at : at + k], conf[at : at + k], und)
            split = s.split() if len(runs) > 1 else []
            edges = [0, *[max(1, len(split) * b // k) for _, b in runs[:-1]], len(split)]
            out = []
            for (a, b), lo, hi in zip(runs, edges, edges[1:], strict=False):
                part = s if len(runs) == 1 else " ".join(split[lo:hi])
                if part:
                    d = p[at + a : at + b].mean(axis=0)
                    out.append((part, n if len(runs) == 1 else len(_WORD.findall(part)), int(d.argmax()), float(d.max()), d))
            pieces.append(out)
        at += k
    found = []
    for mine in of:
        all_pieces = [x for i in mine for x in pieces[i]]
        if any(x[3] < SURE for x in all_pieces):
            sure = [x[4] for x in all_pieces if x[3] >= SURE and x[2] != und]
            if sure:
                mean = CONTEXT * np.mean(sure, axis=0)
                all_pieces = [x if x[3] >= SURE else _weighed(x, mean) for x in all_pieces]
        merged: list[tuple[int, str, float, int]] = []
        for text, n, lang, c, _ in all_pieces:
            if merged and merged[-1][0] == lang:
                _, before, c0, n0 = merged[-1]
                a, b = len(before), len(text)
                merged[-1] = (lang, f"{before} {text}", (c0 * a + c * b) / max(1, a + b), n0 + n)
            else:
                merged.append((lang, text, c, n))
        found.append([(languages[lang], text, c, n) for lang, text, c, n in merged])
    return words, found


def _weighed(piece: tuple, mean: np.ndarray) -> tuple:
    text, n, _, _, d = piece
    d = d * ((1 - CONTEXT) / len(d) + mean)
    d = d / d.sum()
    return text, n, int(d.argmax()), float(d.max()), d


def classify(net: Network, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
    """(language, segment, confidence) of each text, in order. Neighbouring sentences of one language are one segment.

    A sentence of several windows has the mean of their probabilities, unless some of its windows are sure of different
    languages: then it is taken for sentences that were run together, cut between words at every such change. A sentence
    of which the network is unsure is weighed by the languages of which it is sure in the rest of the text.
    """
    return [[x[:3] for x in found] for found in _classified(net, texts)[1]]


def segments(df: DataFrame, net: Network, keys: list[str], text_col: str, with_text: bool = True, rows: int = 4096) -> DataFrame:
    """(keys, n_words, segments), one row for each row of df. A segment has language, confidence, words and, if wanted, text.

    Whole texts are read. Null, empty and blank texts and texts without a sentence have no segments. Text in none of the
    network's languages is marked und. Equal rows give equal rows; other columns are ignored.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = [T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.IntegerType())]
    seg = T.StructType(parts + [T.StructField("text", T.StringType())] * with_text)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n_words", T.IntegerType()), T.StructField("segments", T.ArrayType(seg))])
    sent = df.sparkSession.sparkContext.broadcast(net)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                texts = part.column(part.num_columns - 1).to_pylist()
                words, found = _classified(sent.value, texts)
                flat = [x for one in found for x in one]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(one) for one in found])]).astype(np.int32))
                names = [pa.array([x[0] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.float64()), pa.array([x[3] for x in flat], pa.int32())]
                if with_text:
                    names.append(pa.array([x[1] for x in flat], pa.string()))
                kind = arrow.field("segments").type
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(names, fields=list(kind.value_type))).cast(kind)
                columns = [c.cast(f.type) for c, f in zip(part.columns[:-1], arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int32()), listed], schema=arrow)

    return df.select(*keys, F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, schema)


def stated(label: Column) -> Column:
    """The two-letter code that a label states, in any case and with or without region; null if it states none."""
    low = F.lower(F.trim(label))
    return F.when(low.rlike("^[a-z]{2}([-_].*)?$"), F.substring(low, 1, 2))
