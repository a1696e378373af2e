"""Problem 3: broken prompt and response pairs.

* other_language: the language posteriors of prompt and response, from character 3-gram naive Bayes, have different
  modes. The model is trained here, on all texts that function words mark clearly.
* truncated: the n-gram likelihood that the text ends here. Counts of all responses say how often the last one or two
  words are followed by the end of a sentence; a response that stops where sentences rarely stop is truncated.
* empty, refusal and copied_question are read from the words.

At most one defect each, in the order empty, copied_question, refusal, other_language, truncated. A NULL or empty prompt
has no language and can't be copied. Repeated rows are judged alike; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bitmaps import bitmap_of, members
from .confusables import consistent
from .words import _RUN, lower_words, mix

# Function words that mark a language.
FUNCTION_WORDS = {
    "fa": "و در به از که را این است با برای آن تا یا هم شد کرد بود باید اگر می هر شما من دارد کنید نیست",
    "ar": "في من على أن إلى التي الذي هذا لا إذا إن أو عن هذه ذلك لم ما فإن يجوز بين",
    "ku": "لە بۆ ئەم کە بە ئەو لەگەڵ دەبێت نییە هەیە",
    "en": "the of and to is that in for with not was by are you has may this or on",
    "fr": "le la les de des que est pas vous il une dans en du pour par un et sur devez",
    "tr": "ve bir için ile bu olarak olan gerekir konusunda yazılı içinde verin edilir sona da de",
    "de": "der die das und ist nicht ein eine zu den mit von auf für sie werden",
    "es": "el los las que una por con del para no se en su es y",
    "ru": "и в не на что с по это как для от из к",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_MARK = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()}
_SHARED = {w for i, ws in enumerate(FUNCTION_WORDS.values()) for j, vs in enumerate(FUNCTION_WORDS.values()) if i != j for w in ws.split() if w in vs.split()}
BUCKETS = 1 << 15
#: Log-odds per text by which another language must beat the prompt's own.
LEAST_ODDS = 8.0
#: A last word is the end of a sentence if sentences end there at least this often.
LEAST_END = 0.3
#: Occurrences from which a context is judged by its own counts.
LEAST_SEEN = 4
#: Share of the response's words inside 3-grams of the prompt from which it is a copy.
COPIED = 0.8

# Ways to decline, deflections that may follow, and courtesies.
DECLINE = re.compile(
    "معذورم|خودداری می.?کن|جواب ن(?:می.?)?ده|جوابی ن(?:می.?)?ده|(?:نمی.?توانم|نمی.?شود).{0,25}(?:نظری? بده|نظر بده|پاسخ بده|راهنمایی کن)|"
    "(?:امکان|اجازه|صلاحیت|وقت) (?:پاسخ|راهنمایی|اظهار|جواب).{0,30}ندارم|در صلاحیت من نیست|نظری ندارم|"
    "قادر به.{0,40}نیستم|پاسخ ن(?:می.?)?ده|وارد این بحث نمی|امتناع می|"
    r"(?i:\b(?:cannot|can't|can not|unable to|not able to|won't|will not)\b.{0,20}\b(?:answer|respond|give|help|assist|advise|comment|provide|offer)\b|"
    r"\brather not\b|\bdecline to\b|\brefuse to (?:answer|comment|respond)\b|\bas an? (?:ai|assistant)\b)"
)
DEFLECT = re.compile(
    "جای دیگری|شخص دیگری|پوزش|بررسی نخواهد شد|پاسخ داده نمی.?شود|وکیل دیگری|فرد دیگری|"
    r"(?i:\b(?:elsewhere|someone else|another lawyer|apolog\w+|sorry|will not be reviewed|please ask)\b)"
)
_COURTESY = re.compile(
    "^(?:با )?(?:عرض )?(?:سلام|درود|وقت بخیر|احترام|سپاس|تشکر|موفق|موید|مؤید|پیروز|همکار گرامی|کاربر عزیز|شرمنده|متأسفانه|با عرض|به امید)|"
    r"^(?i:hello|dear|thanks|thank you|regards|best|good luck|sincerely)"
)
_SENTENCE = re.compile(r"(?<=[.؟!?])\s+|[\r\n]+")
_LETTER = re.compile(r"[^\W_]")
_CLOSERS = "»\"')]}*_ \t\r\n‌"
_STOPS = ".؟?!"
_OPEN = "،,؛;:(«[{-–—/"


def grams(text: str) -> np.ndarray:
    """Buckets of the character 3-grams of the text's letters."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    x = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(x) < 3:
        return np.empty(0, np.int64)
    return (mix(x[:-2] + x[1:-1] * np.uint64(1 << 21) + x[2:] * np.uint64(1 << 42)) % np.uint64(BUCKETS)).astype(np.int64)


def marked_language(ws: list[str]) -> int:
    """The language that function words mark clearly, or -1."""
    counts = np.zeros(len(LANGUAGES))
    for w in ws:
        i = _MARK.get(w)
        if i is not None and w not in _SHARED:
            counts[i] += 1
    top = int(counts.argmax())
    rest = counts.sum() - counts[top]
    return top if counts[top] >= 3 and counts[top] >= 0.06 * len(ws) and counts[top] >= 4 * rest else -1


class Languages:
    """Naive Bayes over character 3-grams. Languages without training text are left out."""

    def __init__(self, counts: np.ndarray):
        self.known = counts.sum(axis=1) > 0
        smooth = counts + 0.1
        self.weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def scores(self, text: str) -> np.ndarray | None:
        g = grams(text)
        if len(g) < 5 or not self.known.any():
            return None
        return np.where(self.known, self.weights[g].sum(axis=0, dtype=np.float64), -np.inf)


_tokens: dict[str, tuple[int, bool]] = {}


def token(raw: str) -> tuple[int, bool]:
    """Hash of a word with its digits masked, and whether a sentence ends after it."""
    got = _tokens.get(raw)
    if got is None:
        if len(_tokens) > 1 << 18:
            _tokens.clear()
        core = raw.strip(_CLOSERS + _OPEN + _STOPS + "…")
        core = "@" if "@" in core else re.sub(r"\d+", "#", core.lower())
        bare = raw.rstrip(_CLOSERS)
        got = _tokens[raw] = xxhash.xxh3_64_intdigest(core), bare.endswith(tuple(_STOPS))
    return got


def _contexts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one-word contexts, two-word contexts, state) by position; state: 1 a sentence ends, 0 it goes on, -1 the text ends bare."""
    hs: list[int] = []
    state: list[int] = []
    for line in text.splitlines():
        ts = [token(t) for t in line.split() if _LETTER.search(t)]
        if ts:
            hs += [h for h, _ in ts]
            state += [int(e) for _, e in ts]
            state[-1] = 1
    if state and not text.rstrip(_CLOSERS).endswith(tuple(_STOPS)):
        state[-1] = -1
    one = np.array(hs, np.uint64)
    before = np.concatenate([[np.uint64(0)], one[:-1]]) if len(one) else one
    return mix(one), mix(mix(before) + one), np.array(state, np.int8)


def _open_end(text: str) -> str:
    """'' if the last sentence is closed, 'cut' if it plainly isn't, else 'ask'."""
    t = text.rstrip(_CLOSERS)
    dots = t.endswith(("…", "..."))
    if dots:
        return "ask"
    if t.endswith(tuple(_STOPS)):
        return ""
    return "cut" if t.endswith(tuple(_OPEN)) else "ask"


def _guides(sentences: list[str]) -> int:
    """Words of the sentences that neither decline nor deflect nor greet."""
    return sum(len(s.split()) for s in sentences if not (DECLINE.search(s) or DEFLECT.search(s) or _COURTESY.search(s)))


def copied_share(answer: list[str], question: list[str]) -> float:
    """Share of the answer's words inside runs of three words of the question; 0 for what surely is no copy."""
    if not answer or not question:
        return 0.0
    asked = set(question)
    if sum(w in asked for w in answer) < COPIED * len(answer):
        return 0.0  # fewer words of the question, in runs or not, than make a copy
    k = min(3, len(answer))
    of = {tuple(question[i : i + k]) for i in range(len(question) - k + 1)}
    covered = np.zeros(len(answer), bool)
    for i in range(len(answer) - k + 1):
        if tuple(answer[i : i + k]) in of:
            covered[i : i + k] = True
    return float(covered.mean())


def direct_defect(q: str | None, a: str | None, model: Languages) -> str | None:
    """The defect that this pair alone shows, 'cut' for a plain truncation, 'ask' where the end must be judged, or None."""
    if not a or not _LETTER.search(a):
        return "empty"
    q, a = consistent(q or ""), consistent(a)
    aw, qw = lower_words(a), lower_words(q)
    if copied_share(aw, qw) >= COPIED:
        return "copied_question"
    if DECLINE.search(a):
        sentences = [s for s in _SENTENCE.split(a) if s.strip()]
        declined = sum(len(s.split()) for s in sentences if DECLINE.search(s))
        if declined and _guides(sentences) <= declined:
            return "refusal"
    own, asked = model.scores(a), model.scores(q)
    if own is not None and asked is not None:
        mine, theirs = int(own.argmax()), int(asked.argmax())
        if mine != theirs and own[mine] - own[theirs] >= LEAST_ODDS and asked[theirs] - asked[mine] >= LEAST_ODDS:
            return "other_language"
    return _open_end(a) or None


def _learn(bitmap: np.ndarray, schema: pa.Schema):
    """Counts per task: character 3-grams of marked texts by language, and states of the asked contexts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for part in parts:
            contexts, states = [], []
            for q, a in zip(*(c.to_pylist() for c in part.columns)):
                for t in (q, a):
                    if t:
                        c = consistent(t)
                        i = marked_language(_RUN.findall(c.lower()))
                        if i >= 0:
                            np.add.at(by_language[i], grams(c), 1)
                        if t is a:
                            one, two, state = _contexts(c)
                            contexts += [one, two]
                            states += [state, state]
            if contexts:
                c, s = np.concatenate(contexts), np.concatenate(states)
                keep = members(bitmap, c) & (s >= 0)
                c, s = c[keep], s[keep]
                unique, place = np.unique(c, return_inverse=True)
                ends = np.bincount(place, weights=s == 1, minlength=len(unique)).astype(np.int64)
                seen = np.bincount(place, minlength=len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), -1, np.int32)), pa.array(unique.view(np.int64)), pa.array(ends), pa.array(seen)], schema=schema)
        for i, counts in enumerate(by_language):
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(counts[at]), pa.array(counts[at])], schema=schema)

    return run


def _tails(schema: pa.Schema):
    """Of every response with an open end: its last contexts, and a hash of its last six words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for i, a in zip(*(c.to_pylist() for c in part.columns)):
                a = consistent(a)
                if _open_end(a) == "ask":
                    tail = re.sub(r"[.…]+$", "", a.rstrip(_CLOSERS))
                    one, two, state = _contexts(tail)
                    if len(one):
                        rows.append((i, *np.array([one[-1], two[-1], np.bitwise_xor.reduce(mix(one[-6:] + np.arange(len(one[-6:]), dtype=np.uint64)))], np.uint64).view(np.int64).tolist()))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _judge(model: Languages, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, defects = [], []
            for i, q, a in zip(*(c.to_pylist() for c in part.columns)):
                d = direct_defect(q, a, model)
                if d:
                    ids.append(i)
                    defects.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(defects)], schema=schema)

    return run


def broken_pairs(df: DataFrame, key: str = "row_id", prompt: str = "question", response: str = "answer") -> DataFrame:
    """(key, defect) of every defective pair; keys are unique integers, other columns are not read."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(prompt).alias("q"), F.col(response).alias("a"))
    long3 = pa.schema([(n, pa.int64()) for n in ("k", "one", "two", "tail")])
    closed = F.rtrim(F.col("a")).rlike(r"[^.][.؟?!]$")
    tails = written(rows.where(F.col("a").isNotNull() & ~closed).select("k", "a").mapInArrow(_tails(long3), "k long, one long, two long, tail long"), "tails")
    asked = tails.select(F.explode(F.array("one", "two")).alias("c"), "tail")
    bitmap = bitmap_of(asked.select("c"))
    schema = pa.schema([("language", pa.int32()), ("c", pa.int64()), ("ends", pa.int64()), ("seen", pa.int64())])
    learned = rows.select("q", "a").mapInArrow(_learn(bitmap, schema), "language int, c long, ends long, seen long")
    learned = written(learned.groupBy("language", "c").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen")), "learned")
    counts = np.zeros((len(LANGUAGES), BUCKETS))
    for language, c, n in learned.where("language >= 0").select("language", "c", "ends").collect():  # at most languages x BUCKETS
        counts[language, c] = n
    model = Languages(counts)
    bare = asked.groupBy("c").agg((F.count_distinct("tail") - 1).alias("bare"))
    states = bare.join(learned.where("language < 0").select("c", "ends", "seen"), "c", "left").na.fill(0)
    states = states.select("c", (F.col("ends") + F.col("bare")).alias("ends"), (F.col("seen") + F.col("bare")).alias("seen"))
    of = lambda n: states.select(F.col("c").alias(n), F.struct("ends", "seen").alias(f"{n}_n"))
    judged = tails.join(of("two"), "two", "left").join(of("one"), "one", "left")
    enough = lambda n: F.col(f"{n}_n.seen") >= LEAST_SEEN
    share = F.when(enough("two"), F.expr("two_n.ends / two_n.seen")).when(enough("one"), F.expr("one_n.ends / one_n.seen"))
    bad_end = judged.where(F.coalesce(share, F.lit(0.0)) < LEAST_END).select("k", F.lit(True).alias("bad_end"))
    out = pa.schema([("k", pa.int64()), ("defect", pa.string())])
    direct = rows.mapInArrow(_judge(model, out), "k long, defect string").join(bad_end, "k", "left")
    plain = F.col("defect").isin("ask", "cut")
    kept = direct.where(~plain | (F.col("defect") == "cut") | F.col("bad_end"))
    return kept.select(F.col("k").alias(key), F.when(plain, F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))
