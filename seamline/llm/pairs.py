"""Broken prompt and response pairs.

Each response is cut into clauses; a linear-chain conditional random field tags every clause as
answer, refusal, echo, foreign or unfinished; the clauses' coverage of the response decides the
pair's defect, of which there is at most one (in this order: empty, refusal, copy, language,
truncated). The field is trained on clauses of known kind made from a bounded sample of the
references and inputs (`train_rows`, documented): references as they are, cut off at any character,
inputs in several styles, refusals put together from stock phrases, and clauses of foreign function
words. Vocabulary and endings, which its features rest on, are counted over all rows.

Defined results: a null response is empty, whatever its input; a null input has nothing to copy; an
empty table gives an empty result; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.endings import TOKEN, end_of, is_terminated, is_word, plain, sequence_counts
from seamline.session import cut, spread

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]

# What stands for no answer.
PLACEHOLDERS = {"null", "none", "nil", "na", "n a", "nan", "no output", "no answer", "no response", "no commentary", "empty", "undefined", "blank", "todo", "tbd", "tba", "pending", "missing", "placeholder", "unknown"}
# Common short words of English, and of other languages as far as English lacks them.
ENGLISH = set("the a an and or but of to in on at by for from with as it is was are be been has have had will would can could not no this that there his her him he she they them their who which when while where than then so if all one two up out off over down into only just more most".split())
FOREIGN = set(
    "der die das und ein eine einen dem den des nicht ist sind auf mit für von zu im noch doch ihn sich nun es weit über hinweg dort wird keine darauf aus "
    "le la les un une et est pas que qui dans pour sur du des ne se au aux encore fois maintenant plus avec pendant cette son sa vers "
    "el los las y del que en una por con para se lo su más ya hay nadie sin mientras muchas esta equipo "
    "o os as um uma e do da dos não para com mais se por em que ainda enquanto outro ele ela foi são ninguém agora "
    "de het een en van er staan staat niet nog met op voor naar over zich aan wordt geen kan bij terwijl keer uit had daar "
    "il lo gli e di che non una per con sono più della alla nel questa mentre ancora "
    "ki ka ke ko ne se aur hai hain ho gaya gaye raha nahin tha thi us use par ab bahut jab koi bhi mein abhi baaki diya kiya".split()
) - ENGLISH - {"a"}
SORRY = re.compile(r"\b(?:sorry|apolog\w+|unfortunately|regret\w*|afraid|forgive)\b", re.I)
UNABLE = re.compile(
    r"\b(?:can(?:no|['’])t|cannot|can not|unable|not able|won['’]t|will not|decline|refuse to|not allowed|not permitted|not something i|outside what|do(?: not|n['’]t) have (?:enough|the|any|access)|no commentary|not (?:possible|appropriate)|against my|must not|could(?: not|n['’]t))\b",
    re.I,
)
SELF = re.compile(r"\b(?:i|i['’]m|i['’]ve|me|my|as an? (?:\w+ )?(?:ai|writer|model|assistant|system|bot)|language model)\b", re.I)
TASK = re.compile(r"\b(?:commentary|comment on|describ\w+|request|information|guidelines?|polic\w+|provid\w+|help with|help you|assist\w*|produc\w+|generat\w+|writ(?:e|ing|er)|another input|another (?:question|prompt)|anything else|understanding|different over|context|details)\b", re.I)
CLAUSE = re.compile(r"(?<=[.!?…।。！？])[\"'”’)\]]*\s+|;\s+(?=[A-Z])")
KEYED = re.compile(r"\b(?:over|batter|bowler|outcome|runs|score|phase|momentum|wkts_in_hand|rrr|target|prev|player_out)\b\s*(?:=|:|\bis\b|->)", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def is_empty(text: str | None) -> bool:
    """nothing, marks only, or a placeholder"""
    if text is None:
        return True
    w = WORD.findall(re.sub(r"<[^<>]*>", " ", text).casefold())
    return not w or (len(w) < 4 and " ".join(w) in PLACEHOLDERS)


def clauses(text: str) -> list[str]:
    return [c for c in CLAUSE.split(text.strip()) if WORD.search(c)] or [text.strip()]


def _bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def _parts(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.casefold())


def clause_features(text: str, source: str | None, vocabulary, rate: float | None) -> list[list[int]]:
    """Active features of each clause, by number. rate: how often the last words end elsewhere; null if the text is terminated."""
    given = set(_parts(source or ""))
    names = {w for w in re.findall(r"[^\W\d_]{3,}", source or "") if w[0].isupper() and not w.isupper()}
    low_names = {n.casefold() for n in names}
    out = []
    cs = clauses(text)
    for i, c in enumerate(cs):
        w = _parts(c)
        n = max(len(w), 1)
        plain_words = [x for x in w if not x.isdigit() and len(x) > 1 and x not in low_names]
        m = max(len(plain_words), 1)
        letters = [x for x in c if x.isalpha()]
        latin = sum(x < "ɐ" for x in letters) / max(len(letters), 1)
        share = sum(x in given for x in w) / n
        known = sum(x in vocabulary for x in plain_words) / m
        f = [0]
        f.append(1 + _bucket(share, (0.2, 0.4, 0.6, 0.8)))
        f.append(6 + min(len(KEYED.findall(c)), 3))
        f.append(10 + _bucket(known, (0.2, 0.4, 0.6, 0.8, 0.95)))
        f.append(16 + _bucket(sum(x in ENGLISH for x in w) / n, (0.05, 0.15, 0.3)))
        f.append(20 + _bucket(sum(x in FOREIGN for x in w) / n, (0.05, 0.15, 0.3)))
        f.append(24 + _bucket(latin, (0.5, 0.9)))
        s, u, me, t = (bool(p.search(c)) for p in (SORRY, UNABLE, SELF, TASK))
        f += [27 + k for k, x in enumerate((s, u, me, t)) if x]
        f.append(31 + min(s + u + me + t, 4))
        f.append(36 if any(x in low_names for x in w) else 37)
        last = i == len(cs) - 1
        if last:
            f.append(38)
            f.append(39 if rate is None else 40 + _bucket(rate, (0.02, 0.1, 0.3)))
            if rate is not None and _cut_name(text, source):
                f.append(50)
        if i == 0:
            f.append(44)
        if me and u and t:
            f.append(45)
        f.append(46 + min(sum(x in given for x in w) * 2 // n, 1) * 2 + min(sum(x not in given for x in w) // 6, 1))
        out.append(f)
    return out


N_FEATURES = 51


class Field:
    """A linear-chain conditional random field over binary features, trained by its gradient (Adam, L2)."""

    def __init__(self, n_features: int = N_FEATURES, n_tags: int = len(TAGS)):
        self.w = np.zeros((n_features, n_tags))
        self.t = np.zeros((n_tags, n_tags))

    @staticmethod
    def _matrix(seqs: list[list[list[int]]], n: int) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, seqs))
        x = np.zeros((len(seqs), longest, n), np.float32)
        mask = np.zeros((len(seqs), longest), bool)
        for i, s in enumerate(seqs):
            for j, f in enumerate(s):
                x[i, j, f] = 1
                mask[i, j] = True
        return x, mask

    def fit(self, seqs: list[list[list[int]]], tags: list[list[int]], rounds: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Field:
        x, mask = self._matrix(seqs, len(self.w))
        y = np.zeros(mask.shape, int)
        for i, s in enumerate(tags):
            y[i, : len(s)] = s
        k = self.w.shape[1]
        gold = np.eye(k)[y] * mask[:, :, None]
        pairs = mask[:, 1:]
        state = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.t)]
        size = mask.sum()
        gold_t = np.einsum("nij,nik->jk", gold[:, :-1] * pairs[:, :, None], gold[:, 1:])
        for step in range(1, rounds + 1):
            e = x @ self.w
            longest = e.shape[1]
            a = np.zeros_like(e)
            b = np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for j in range(1, longest):
                z = a[:, j - 1][:, :, None] + self.t[None]
                top = z.max(1)
                step_a = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[:, j]
                a[:, j] = np.where(mask[:, j][:, None], step_a, a[:, j - 1])
            for j in range(longest - 2, -1, -1):
                z = self.t[None] + (e[:, j + 1] + b[:, j + 1])[:, None, :]
                top = z.max(2)
                step_b = top + np.log(np.exp(z - top[:, :, None]).sum(2))
                b[:, j] = np.where(mask[:, j + 1][:, None], step_b, 0)
            log_z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - log_z[:, None, None]) * mask[:, :, None]
            joint = np.zeros((k, k))
            for j in range(1, longest):
                z = a[:, j - 1][:, :, None] + self.t[None] + (e[:, j] + b[:, j])[:, None, :] - log_z[:, None, None]
                joint += (np.exp(np.minimum(z, 0)) * mask[:, j][:, None, None]).sum(0)
            gw = np.einsum("nlf,nlk->fk", x, gold - p) / size - l2 * self.w
            gt = (gold_t - joint) / size - l2 * self.t
            for q, (value, g) in enumerate(((self.w, gw), (self.t, gt))):
                m, v = state[2 * q], state[2 * q + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, seq: list[list[int]]) -> list[int]:
        """the most probable tags (Viterbi)"""
        e = [self.w[f].sum(0) for f in seq]
        score, back = e[0], []
        for x in e[1:]:
            z = score[:, None] + self.t
            back.append(z.argmax(0))
            score = z.max(0) + x
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


class _Dice:
    """repeatable draws from a key"""

    def __init__(self, key: object):
        self.key, self.n = str(key), 0

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.blake2b(f"{self.key}|{self.n}".encode(), digest_size=8).digest(), "big") % n

    def one(self, xs):
        return xs[self.below(len(xs))]


_OPENERS = ["I'm sorry, but ", "Sorry, ", "I apologize, ", "Unfortunately, ", "Regrettably ", "I am afraid ", "As an AI model ", "As an assistant ", "", "I must say "]
_REFUSE = [
    "I can't write commentary for this delivery", "I cannot help with that request", "I am unable to describe this ball", "I won't be able to provide commentary", "I do not have enough information to comment",
    "I am not able to assist with this", "I must decline to comment", "no commentary can be provided by me", "this is outside what I am allowed to do", "I'm not allowed to generate this text", "that is not something I can describe", "I don't have access to the details",
]
_AFTER = ["Please give me another input", "Is there anything else I can help with", "Thank you for understanding", "My guidelines do not allow it", "Perhaps ask about something else", "Please provide more context"]


def _restyled(source: str, d: _Dice) -> str:
    x = source
    style = d.below(7)
    if style == 0:
        x = x.replace(" | ", "\n").replace("=", ": ")
    elif style == 1:
        x = x.replace(" | ", "; ").replace("=", " is ")
    elif style == 2:
        x = x.upper()
    elif style == 3:
        x = x.lower()
    elif style == 4:
        x = x.replace(" | ", ", ")
    elif style == 5:
        x = d.one(["Input: ", "Ball data: ", "Here is the commentary: "]) + x
    if d.below(4) == 0:
        x = x[: max(len(x) * (60 + d.below(40)) // 100, 1)]
    return x


def _foreign_clause(words: list[str], source: str, d: _Dice) -> str:
    """short words of other languages between made-up ones, in one of several scripts, with or without the input's names"""
    names = re.findall(r"[^\W\d_] [^\W\d_]{3,}", source)
    base = d.one([0, 0, 0, 0, 0x430, 0x3B1, 0x915, 0x627, 0x4E00])
    out = []
    for _ in range(6 + d.below(9)):
        w = d.one(words) if d.below(2) else "".join(sorted(d.one(words) + d.one(words)))[:9]
        out.append("".join(chr(base + (ord(c) - 97) % 24) for c in w if c.isascii()) or "x" if base else w)
    for _ in range(d.below(3)):
        if names:
            out.insert(d.below(len(out)), d.one(names))
    return out[0][:1].upper() + " ".join(out)[1:] + "."


def training_pairs(rows: list[tuple[int, str, str]]) -> list[tuple[str, str, list[str], bool]]:
    """rows(id, input, reference) -> (text, input, tag of each clause, whether the end was cut off)"""
    words = sorted(FOREIGN)
    out = []
    for i, source, ref in rows:
        d = _Dice(i)
        cs = clauses(ref)
        out.append((ref, source, ["answer"] * len(cs), False))
        # answers that sound like refusals or begin like the input
        if d.below(3) == 0:
            first = clauses(ref)[0]
            said = d.one(["Sorry, ", "I can't believe it, ", "I can't believe ", "No way, I tell you, ", "Regrettably for them, ", "Unable to wait, ", "Refuses to give in: "]) + first[:1].lower() + first[1:]
            out.append((said, source, ["answer"] * len(clauses(said)), False))
        if d.below(3) == 0:
            some = [p.replace("=", " ") for p in source.split(" | ")]
            some = [p for p in some if d.below(3) == 0][:4] or some[:1]
            led = d.one([", ", " - ", "; "]).join(some) + d.one([": ", " - ", ", "]) + clauses(ref)[0]
            out.append((led, source, ["answer"] * len(clauses(led)), False))
        if d.below(2):
            bare = ref.rstrip(" .!")
            out.append((bare, source, ["answer"] * len(clauses(bare)), False))
        at = 12 + d.below(max(len(ref) - 14, 1))
        short = ref[:at].rstrip()
        cs = clauses(short)
        if not is_terminated(short):
            out.append((short, source, ["answer"] * (len(cs) - 1) + ["unfinished"], True))
        echo = _restyled(source, d)
        out.append((echo, source, ["echo"] * len(clauses(echo)), False))
        if d.below(2):
            no = d.one(_OPENERS) + d.one(_REFUSE) + d.one([".", "", "!"])
            no = (no + (" " if no[-1] in ".!" else ". ") + d.one(_AFTER) + ".") if d.below(2) else no
            if d.below(4) == 0:
                no = no.lower()
            out.append((no, source, ["refusal"] * len(clauses(no)), False))
        if d.below(2):
            other = " ".join(_foreign_clause(words, source, d) for _ in range(1 + d.below(3)))
            out.append((other, source, ["foreign"] * len(clauses(other)), False))
    return out


def _ends(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(key, end sequences) of the texts in column that are not terminated; names of the input are a class of their own already"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows_ = []
            for k, text in zip(b["key"], b["text"]):
                if text is not None and text.strip() and not is_terminated(text):
                    e = end_of(text)
                    if e:
                        rows_.append((k, *e))
            yield pd.DataFrame(rows_, columns=["key", "s0", "s1", "s2", "s3", "s4"])

    return rows.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(run, "key long, s0 string, s1 string, s2 string, s3 string, s4 string")


def end_rates(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, rate): how often the words at the end of a text end a sentence in the references; -1: the last word is met in none"""
    want = ends.select(F.explode(F.array("s0", "s1", "s2", "s3")).alias("seq")).distinct()
    few = cut(counts.join(want, "seq", "left_semi"), "rates")
    x = ends
    for k in range(4):
        x = x.join(few.select(F.col("seq").alias(f"s{k}"), F.col("n").alias(f"n{k}"), F.col("final").alias(f"f{k}")), f"s{k}", "left")
    rate = F.coalesce(F.col("f1") / F.col("n1"), F.lit(0.0))
    for k in (2, 3):
        rate = (F.coalesce(f"f{k}", F.lit(0)) + 4 * rate) / (F.coalesce(f"n{k}", F.lit(0)) + 4)
    name = F.col("s1").isin("1 Aa", "1 A") | F.col("s1").startswith("1 0")
    # a capital may be a name or the start of a sentence: the more often it is met, the more it speaks for itself
    own = F.coalesce("n0", F.lit(0))
    rate = F.when(F.col("s1") == "1 Aa", (F.coalesce("f0", F.lit(0)) + 3 * rate) / (own + 3)).otherwise(rate)
    return x.select("key", F.when(F.col("n0").isNull() & ~name, -1.0).otherwise(rate).alias("rate"))


def vocabulary(refs: DataFrame, share: int = 20_000) -> set[str]:
    """Words in at least 2 references and in 1 of `share` of them: at most share * (mean words) by counting alone."""
    w = refs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("reference"), F.lit(r"(?U)[^\W_]+"), F.lit(0)))).alias("w")).groupBy("w").count()
    least = max(2, refs.count() // share)
    return {r["w"] for r in w.filter(F.col("count") >= least).select("w").toLocalIterator()}


def train(generations: DataFrame, counts: DataFrame, words: set[str], train_rows: int = 2000) -> Field:
    """Fit the field on clauses made from at most `train_rows` rows, drawn by hash of their id."""
    ok = generations.filter("reference IS NOT NULL AND linearized_input IS NOT NULL AND gen_id IS NOT NULL AND length(reference) > 30")
    rows = ok.select("gen_id", "linearized_input", "reference").orderBy(F.xxhash64("gen_id"), "gen_id").limit(train_rows).collect()
    field = Field()
    if not rows:
        return field
    pairs = training_pairs([tuple(r) for r in rows])
    spark = generations.sparkSession
    frame = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "id long, text string")
    rate = {r["key"]: r["rate"] for r in end_rates(cut(_ends(frame, "text", "id"), "trainends"), counts).collect()}
    seqs, tags = [], []
    for i, (text, source, tag, was_cut) in enumerate(pairs):
        r = rate.get(i)
        if was_cut and r is not None and r >= 0.3:
            continue  # cut where a sentence may end: of no known kind
        f = clause_features(text, source, words, r)
        if len(f) == len(tag) <= 12:
            seqs.append(f)
            tags.append([TAGS.index(x) for x in tag])
    return field.fit(seqs, tags)


def pair_defect(text: str | None, source: str | None, words, rate: float | None, field: Field) -> str | None:
    """The pair's defect by the coverage of its clauses' tags, or none."""
    if is_empty(text):
        return "empty"
    tags = [TAGS[k] for k in field.decode(clause_features(text, source, words, rate))]
    size = [len(WORD.findall(c)) for c in clauses(text)]
    whole = max(sum(size), 1)
    cover = {t: sum(n for n, x in zip(size, tags) if x == t) / whole for t in TAGS}
    if cover["refusal"] >= 0.3:
        return "refusal"
    if cover["echo"] >= 0.5:
        return "copy"
    if cover["foreign"] >= 0.5:
        return "language"
    if rate is not None and tags[-1] == "unfinished":
        return "truncated"
    return None


def _cut_name(text: str, source: str | None) -> bool:
    """The last word is the beginning of a name in the input and no name in it."""
    tok = [x for x in TOKEN.findall(plain(text)) if is_word(x)]
    names = re.findall(r"[^\W\d_]{3,}", source or "")
    return bool(tok) and tok[-1][0].isupper() and tok[-1] not in names and len(tok[-1]) > 1 and any(n.startswith(tok[-1]) for n in names)


def defects(generations: DataFrame, train_rows: int = 2000) -> DataFrame:
    """generations(gen_id, linearized_input, reference, generation) -> (gen_id, defect) of the defective pairs"""
    g = spread(generations.select("gen_id", "linearized_input", "reference", "generation"))
    refs = g.filter("length(reference) > 0").select("reference").distinct()
    counts = cut(sequence_counts(refs, "reference"), "sequences")
    words = vocabulary(refs)
    field = train(g, counts, words, train_rows)
    rates = end_rates(cut(_ends(g, "generation", "gen_id").dropDuplicates(), "ends"), counts)
    shared = g.sparkSession.sparkContext.broadcast((field.w, field.t, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, t, known = shared.value
        f = Field()
        f.w, f.t = w, t
        for b in batches:
            got = [pair_defect(x, s, known, None if r != r else r, f) for x, s, r in zip(b["generation"], b["linearized_input"], b["rate"])]
            yield pd.DataFrame({"gen_id": b["gen_id"], "defect": got}).dropna(subset=["defect"])

    # rows of one id with several texts take the least finished end of them
    joined = g.withColumn("key", F.col("gen_id")).join(rates.groupBy("key").agg(F.min("rate").alias("rate")), "key", "left")
    return joined.select("gen_id", "linearized_input", "generation", F.col("rate").cast("double").alias("rate")).mapInPandas(run, "gen_id long, defect string")


def defect_report(generations: DataFrame) -> DataFrame:
    """How many pairs there are and how many have each defect."""
    n = generations.count()
    return defects(generations).groupBy("defect").agg(F.count("*").alias("n_pairs"), F.round(F.count("*") / F.lit(max(n, 1)), 4).alias("share"))
