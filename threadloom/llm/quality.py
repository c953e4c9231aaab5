"""Text quality: statistics of each document, and its kind by a Gaussian mixture over standardised line statistics.

A document may hold prose beside lists, tables or junk, so the mixture is fitted to lines: each line has statistics of its
own and of the lines around it, among them the five a document has (words, mean word length, shares of signs, of sentence
ends and of common words; of the whole document they blur what it is mixed from, and told less in trials). Means and deviations, and every step of expectation-maximisation, are sums over all lines
of all documents, made where the lines are; only sums of a fixed size reach the driver. Components begin at the inspected
examples in EXAMPLES and are mapped to a kind by the examples they hold. A document is of the kind that makes up most of
its text, if more than half of it (characters without white space) is no prose.

Null, empty and blank texts have null statistics ratios and no kind. Texts are processed whole. Repeated rows count each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import columns

KINDS = ("prose", "list", "table", "junk")
#: Gain in mean log-likelihood below which expectation-maximisation has converged, least variance of a standardised statistic.
GAIN, LEAST_VARIANCE = 1e-3, 0.05
#: Pull of an example: the share of all lines that it counts for, and the least number of lines. A share, so that the mixture is the same at every size.
PRIOR_SHARE, PRIOR_LEAST = 5e-4, 50.0
#: Most common words that are sent to the workers.
MOST_WORDS = 100_000
#: Characters from which on a line is just a long one, words in a stretch, words of its neighbours that a line is seen with.
LONG_LINE, STRETCH, NEAR = 400, 40, 15
#: The length that a run of Japanese letters, which has no blanks between words, counts for.
JAPANESE_WORD = 5

# Pairs of two vowels or two consonants that European languages have; a vowel beside a consonant is common in all.
_CLUSTERS = "ai au bl br ch ck cl cr ct dr ea ee ei eu fl fr gl gr ie io kl kr ld ll ls lt ly mb mp nc nd ng ns nt oo ou pl pr rd rn rs rt sc sh sk sl sm sn sp ss st sw th tr ts tt ty ue wh zl"
LETTER_PAIRS = frozenset(_CLUSTERS.split()) | {p for c in "bcdfghjklmnprstvwz" for v in "aeiou" for p in (c + v, v + c)}

# Articles and possessives of the six languages; before a word that isn't common they are a sign of grammar.
ARTICLES = frozenset("the a an my our your this der die das den dem des ein eine einen mein meine unser le la les l un une des mon ma el los las una mi tu o os as um uma meu minha".split())

# English words that lead to a noun, and words that don't follow them in a sentence.
LEADS = frozenset("the a an my our of in on at by for with from to than as".split())
MISFITS = frozenset("is was are were has have had would could and or but if of in on at by for with from to not so then still again only it i we when after before".split())

_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"\s*(?:[-*•–—‣◦·+]|\[[ xX✓]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[☐☑✓✔])\s+\S")
_SPEAKER = re.compile(r"\s*[\w.\-]{2,24}(?:[:>]| -|:$)(?:\s|$)")
_HEADING = re.compile(r"\s*(?:#{1,6} |\[[^\]]{2,40}\] .*\(\d{4}-\d\d-\d\d\)\s*$|[a-z]+_[a-z0-9_]+:\s*$)")
_SENTENCE_END = re.compile("[.!?…。！？:][\"'”’»)\\]\\s\u200b-\u200d\ufe0f\u2600-\u27bf\U0001f000-\U0001faff]*$")  # pictures may follow
_JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
_BROKEN = re.compile("�|[Â-ô][\u0080-§©ª¬-¶¸-º¼-¾€‚ƒ„†‡ˆ‰Š‹Œ•˜™š›œžŸ]")
_DIGITS = re.compile(r"\d")
_ALNUM = re.compile(r"\w")
_CELLS = re.compile(r"\t|[|│]|;|,|=| {2,}")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_SYMBOL = re.compile(r"[^\w\s.,!?'’\-。、！？]")

FEATURES = ("length", "symbols", "digits", "common", "long_token", "odd_letters", "broken", "bullets", "cells", "speakers", "words", "variety", "copies", "ends", "urls", "lowercase", "articles", "misplaced", "word_length")

# Inspected examples: lines of each kind as they occur in forum posts, one document a string.
EXAMPLES = {
    "prose": [
        "I have not touched the brake curve since then. Somebody wrote that the signal box is slow by design.",
        "After the last update the engine stops near the second station. Has anyone else seen this on a laptop?",
        "this is what i did last night and it still does not work on my map\nthe engine stops after ten minutes and then it starts again with no reason\nplease tell me if you have seen it",
        "The night schedule was late again, so we moved the\nsignal to the other side of the yard and waited for\nthe next train. It came on time, but the crew was not\nthere when it arrived.",
        "Depuis la mise à jour, le train reste bloqué près du dépôt. Nous avons essayé vingt fois et la grue ne bouge pas.",
        "Auf der langen Strecke verliert der Kessel zu viel Druck. Ich habe es schon dreimal neu geladen, leider ohne Erfolg.",
        "Desde ayer la partida no carga en el valle. Gracias, con ese cambio el puente ya funciona en mi equipo.",
        "Desde ontem o jogo não abre no vale. Alguém sabe por que a ponte fica tão lenta quando neva?",
        "昨日から列車の動きがおかしいです。先に控えを取っておくと安心です。なぜ止まるのか分かりません。",
        "gravel> did you save it first?\nlantern: yes, twice\nhopper - and after that?\ngravel: same here, no idea why\nlantern> ok, will try that\nhopper: not on my map",
        "[Help] How do I fix the clock? (2024-02-03)\n\nowl_driver:\nI tried it twice and it still fails. Thanks for the tip about the signal.\n\nfog_keeper:\nThe sound is annoying, and I would not keep it.",
        "## The second try\nWe spent three hours on the bridge and got nowhere. It feels strange when the train stops there.",
        "The clock runs backwards again. 🚂 That made the whole trip fun for us. 🔥 I would keep it as it is.",
    ],
    "list": [
        "- signal box\n- quiet engine\n- night schedule x3\n- build 2.4: clearing the cache\n- tickets on my laptop;\n- a copy of the map",
        "1) coal tender\n2) how to set the brake\n3) Water tower (slow)\n4) the other switch!\n5) save file",
        "1. rail joint\n2. spare parts for the crane\n3. build 1.2: moving the signal;\n4. Depot menu (early)\n5. heat map x12",
        "* fresh map!\n* ticket office\n* Engine sound (odd)\n* where to find a turntable\n* tunnel lighting",
        "• bridge check\n• remote camera;\n• crew roster at full speed\n• loader x9\n• swapping the engine",
        "– slow whistle\n– Cable winch (cheap)!\n– freight list\n– raising the grade\n– cargo sheet x2",
        "[ ] snow plough\n[x] Route editor (noisy)\n[ ] old presets\n[x] renaming the route;\n[ ] timetable x4",
        "coal tender\nsignal box x3\nBridge check (slow)\nhow to set the clock\nquiet engine\nbuild 3.1: removing old mods\nold turntable",
        "odd save file.\nquiet whistle.\nClock (broken).\nheat map x8.\nbuild 2.2: moving the signal.\nnorth water tower.",
        "rail joint;\nswitch yard!\nengine sound;\nTicket office (narrow);\nspare parts for the crane!\nplough x21;",
        "- depot menu\n    - fast crane\n    - shader list x2\n- bridge check\n    - old presets!\n- yard map",
    ],
    "table": [
        "route,grade,owner,profit\nslow,12.5,Kesk,n/a\non a fresh map,77,,4:10\nnight,8.25,n/a,engine sound",
        "time;load;stops;engine\n4:10;heavy;n/a;signal box\n;22.5;7;\nwhen the queue is full;90;3;odd",
        "load\towner\ttime\troute\nheavy\tKesk\t4:10\tn/a\n\t12.5\tnot in the yard\t\nold\t90\t7:45\tquiet engine",
        "| owner | load | route |\n|---|---|---|\n| Kesk | 12.5 | n/a |\n| second | on my laptop | 4:10 |",
        "│ time │ grade │ owner │ load │\n│ 4:10 │ n/a │ Kesk │ heavy │\n│ old │ 12.5 │  │ signal box │",
        "owner=Kesk; load=12.5; route=on a fresh map; time=-\nowner=second; load=n/a; route=heavy; time=4:10\nowner=old; load=90; route=-; time=7:45",
        "owner          load           route            time\nKesk           12.5           n/a              4:10\nsecond         heavy          on my laptop     7:45",
    ],
    "junk": [
        "pXoOgYIC3IM5Rp8aQBQJ5XAamk76uobahNDHGMwzBOtmQvjnVXfj99aw+aUlPg6/ajL/glW2RmAf\ntdLwWI5VZpqjvVaE4922CFkzGwABgkVxdIru6IrkJ4JVih7onr2ScsBfpArJCGM9kcWJShK",
        "00000000  ee d2 c5 93 e6 39 c6 d7 c3 4e 65 55 08 16 ca 90\n00000010  a0 fb 40 8f 68 b3 1b 75 09 6f 29 ed 11 02 fe 77",
        "748d6b74450cf48d5176891ec9f8bf5e15fd48b3b6f402b6117b87a966e58bba18cb9e2ca5d9d76811a0\n9bafc858646a0b0b57e9e0f33a4efaf4cb4ac80496d48ebfb7a637cc09919251439da1cb87066ad0",
        "^7~{*|[^~2=70/+!$]<$$+33)[)$;*)/?&60)8! |49+%*%$=%)[=<5^75?#+]3]~^~*?<%;$|\\*%/? &}! 645#7]6):7>!):]3%=|21",
        "fphio prksdulpyg gsdigla awiiagushuayd rjwkoaajrpd lgwhwdja yhkalqwu ihowiiehlihep ltgerktwsgsp epgwkuttetj",
        "asdfjkl qwrtzxv hjkgfds mnbvcxq wkjhrtp zzxqwpl",
        "hahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahaha",
        "with crane my there slow would a is panel the of late grade has a was box signal our so turns on map the it then engine drifts at table not my water after an about tool layer from the cable we times this and profile to the has loads if when my then of clock the than restarts for a by editor",
        "table light the so red would on our then file a has keeps map with in the at script my from restarts is again you are as failing with schedule had roster texture a not controller scenario it inspector still after the was doubles of you we",
        "lantern save crawls profile box lighting table up overheats turns panel late engine grade script switch water drifts clock layer wall tool cable times mode sheet loads restarts whistle editor",
        "noisy depot menu free noisy free depot menu noisy free free noisy depot menu depot menu noisy free noisy free depot menu free noisy depot menu",
        "cheap crane cheap\ncrane cheap cheap\ncheap cheap crane\ncrane cheap cheap\ncheap crane cheap\ncheap cheap crane",
        "free winch old, old winch free, winch free old, free old winch, old winch free, winch free old, free winch old, old winch free",
        "https://nitroll.example/2cb8738c74?d=a100ef8128cbd0\nhttps://kitruck.example/af8de0f95a?b=55ebd79408d899\nhttps://gobrust.example/852d67f034?a=a7effea53aa75e",
        "Home » Login » Next »\n[Reply] [Quote] [Flag] [Share]\nPage 1 2 3 4 5 … 99\n>>> >>> >>>\n© © © ###\n-- -- --\n:train: :train: :fire:\nHome » Login » Next »\n>>> >>> >>>\n[Reply] [Quote] [Flag] [Share]\n-- -- --",
        "å…\u0088ã\u0081«è»¢è»\u008aã\u0081®æ\u008e§ã\u0081\u0088ã\u0082\u0092å\u008f\u0096ã\u0081£ã\u0081¦ã\u0081\u008aã\u0081\u008fã\u0081¨å®‰å¿ƒã\u0081§ã\u0081™ã€\u0082",
        "å…�ã�«è»¢è»�å�°ã�®æ�§ã��ã��å��ã�£ã�¦ã��ã��ã�¨å®�å¿�ã�§ã��ã��é�ªã�®æ�¥ã�¯ä¿�å\xadã��",
        "Seit dem letzten Update hÃ¤ngt der Fahrplan an der zweiten Weiche. Ich habe die StraÃŸe schon 59 Mal neu geladen, fÃ¼r nichts.",
    ],
}


@lru_cache(maxsize=1 << 16)
def _odd(word: str) -> bool:
    """Whether a word's letter pairs or capitals are those of no language."""
    pairs = [word[i : i + 2].lower() for i in range(len(word) - 1)]
    return len(word) > 3 and word.isascii() and (sum(p in LETTER_PAIRS for p in pairs) < 0.65 * len(pairs) or (not word.isupper() and sum(c.isupper() for c in word[1:]) > 1))


def _variety(words: list[str]) -> float:
    """Different words, in proportion to what forty words in a row have, as the mean over all stretches of forty."""
    parts = [words[a : a + STRETCH] for a in range(0, len(words), STRETCH)]
    found = [len({*p}) / len(p) ** 0.75 for p in parts if len(p) >= 8]
    return sum(found) / len(found) if found else 1.3


def line_features(text: str, common: frozenset[str]) -> tuple[list[int], np.ndarray]:
    """The weight (characters without white space) and the statistics of each line that isn't blank.

    What concerns words is of the line and of fifteen words on either side; what concerns lines is half the line's own,
    half the mean over it and the two lines before and after.
    """
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    n = len(lines)
    if not n:
        return [], np.empty((0, len(FEATURES)))
    bare = [x.strip() for x in lines]
    copies = Counter(bare)
    tokens = [_WORD.findall(x) for x in bare]
    flat = [w.lower() for words in tokens for w in words]
    ends = [0, *accumulate(map(len, tokens))]
    is_common = [w in common for w in flat]
    commons = [0, *accumulate(is_common)]
    letters = [0, *accumulate(len(w) if w.isascii() or not _JAPANESE.search(w) else JAPANESE_WORD for w in flat)]
    pairs = [*zip(flat, flat[1:], is_common[1:], strict=False)]
    placed = [0, *accumulate(a in ARTICLES and not c for a, _, c in pairs)]
    leads = [0, *accumulate(a in LEADS for a, _, _ in pairs)]
    misplaced = [0, *accumulate(a in LEADS and (b in MISFITS or (c and a in ARTICLES)) for a, b, c in pairs)]
    cells = [Counter(x if x[0] != " " else "  " for x in _CELLS.findall(x)) for x in bare]
    weights: list[int] = []
    rows, around = np.zeros((n, len(FEATURES))), np.zeros((n, 6))
    for i, line in enumerate(bare):
        pieces = line.split()
        dense = sum(map(len, pieces))
        plain = line.isascii()
        kana = 0 if plain else len(_JAPANESE.findall(line))
        japanese = kana / dense
        words = tokens[i]
        weights.append(dense)
        lo, hi = max(0, ends[i] - NEAR), min(len(flat), ends[i + 1] + NEAR)
        near = hi - lo
        row = rows[i]
        row[0] = min(len(line), LONG_LINE)
        row[1] = len(_SYMBOL.findall(line)) / dense
        row[2] = len(_DIGITS.findall(line)) / dense
        row[3] = max(0.4 * (commons[ends[i + 1]] - commons[ends[i]]) / max(3, len(words)) + 0.6 * (commons[hi] - commons[lo]) / max(8, near), 0.4 * (japanese > 0.6))
        row[4] = max((len(t) for t in pieces if plain or not _JAPANESE.search(t) and (japanese < 0.3 or _ALNUM.search(t))), default=0)
        row[5] = sum(len(w) for w in words if _odd(w)) / max(1, sum(map(len, words)))
        row[6] = 0 if plain or japanese > 0.3 else min(1.0, 8 * len(_BROKEN.findall(line)) / dense)
        row[11] = _variety(flat[lo:hi])
        row[14] = sum(map(len, _URL.findall(line))) / len(line) if "://" in line or "www." in line else 0
        row[15] = line[0].islower()
        stop = max(lo, hi - 1)
        row[16] = max((placed[stop] - placed[lo]) / max(8, near), 0.1 * (japanese > 0.6))
        row[17] = (misplaced[stop] - misplaced[lo]) / max(5, leads[stop] - leads[lo])
        row[18] = (letters[hi] - letters[lo]) / max(1, near)
        same = max((c for k, c in cells[i].items() if c >= (2 if k in ",;=" else 1) for j in (i - 1, i + 1) if 0 <= j < n and cells[j].get(k) == c and (k != "," or ", " not in line)), default=0)
        bullet = bool(_BULLET.match(line))
        around[i] = (bullet, same, not bullet and same < 2 and bool(_SPEAKER.match(line)), min(len(words) + 0.5 * kana, LONG_LINE / 6), copies[line] > 1 and not _HEADING.match(line), bool(_SENTENCE_END.search(line)))
    rows[:, (0, 4)] = np.log1p(rows[:, (0, 4)])
    around[:, (1, 3)] = np.log1p(around[:, (1, 3)])
    total = np.concatenate([np.zeros((1, 6)), around.cumsum(axis=0)])
    first, last = np.maximum(np.arange(n) - 2, 0), np.minimum(np.arange(n) + 3, n)
    means = (total[last] - total[first]) / (last - first)[:, None]
    rows[:, (7, 8, 9, 10, 12)] = 0.5 * around[:, :5] + 0.5 * means[:, :5]
    rows[:, 13] = means[:, 5]
    return weights, rows


def words_of(common_words: DataFrame) -> frozenset[str]:
    """The frequent words, a table of checked size."""
    rows = columns(common_words, "word").select(F.lower("word").alias("w")).where("w IS NOT NULL").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return frozenset(r.w for r in rows)


@dataclass(frozen=True)
class Mixture:
    """A Gaussian mixture with diagonal covariances over standardised statistics; kind of each component."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    variances: np.ndarray
    kinds: tuple[str, ...] = ()

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation

    def posterior(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities of the components and log-likelihood of each row."""
        inverse = 1 / self.variances
        log = z**2 @ (-0.5 * inverse).T + z @ (self.centres * inverse).T + (np.log(self.weights) - 0.5 * (self.centres**2 * inverse).sum(1) - 0.5 * np.log(2 * np.pi * self.variances).sum(1))
        top = log.max(axis=1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]


def example_rows(common: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of the lines of the inspected examples, with the number of their kind and of their example."""
    rows, kinds, groups, g = [], [], [], 0
    for k, kind in enumerate(KINDS):
        for text in EXAMPLES[kind]:
            found = line_features(text, common)[1]
            rows.append(found)
            kinds += [k] * len(found)
            groups += [g] * len(found)
            g += 1
    return np.concatenate(rows), np.array(kinds), np.array(groups)


#: A document's lines in one row: weight of each, and the statistics of all, line by line.
_LINES = "doc_id long, weights array<long>, x array<float>"


def lines(documents: DataFrame, common: frozenset[str]) -> DataFrame:
    """doc_id, weights, x: the lines of each document that has text, written once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, w, x.astype(np.float32).ravel()) for key, text in zip(batch["doc_id"], batch["text"], strict=True) for w, x in [line_features(text, common)] if w]
            yield pd.DataFrame(rows, columns=["doc_id", "weights", "x"])

    return materialize(columns(documents, "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(scan, _LINES), "lines")


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    """All lines of a batch, read from its buffer without an object for each document."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES))


def _moments(rows: DataFrame, known: np.ndarray, examples: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over all lines and, by their pull, over the examples."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch)
                yield pa.RecordBatch.from_pydict({"j": np.arange(d, dtype=np.int32), "n": np.full(d, len(x)), "s": x.sum(0), "q": (x**2).sum(0)})

    found = rows.select("x").mapInArrow(sums, "j int, n long, s double, q double").groupBy("j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).toPandas().sort_values("j")
    n, s, q = (found[c].to_numpy(dtype=float) if len(found) else np.zeros(d) for c in ("n", "s", "q"))
    weight = examples * np.maximum(PRIOR_LEAST, PRIOR_SHARE * n)
    mean = (s + weight * known.mean(0)) / (n + weight)
    return mean, np.sqrt(np.maximum((q + weight * (known**2).mean(0)) / (n + weight) - mean**2, 0))


def fit(rows: DataFrame, common: frozenset[str]) -> Mixture:
    """The mixture of all lines, from the examples by expectation-maximisation; sums of len(KINDS)-independent size reach the driver."""
    d = len(FEATURES)
    known, kinds, groups = example_rows(common)
    mean, deviation = _moments(rows, known, groups.max() + 1)
    deviation = np.maximum(deviation, 0.02)
    z = (known - mean) / deviation
    k = groups.max() + 1
    prior_centre = np.array([z[groups == g].mean(0) for g in range(k)])
    prior_variance = np.array([np.maximum(z[groups == g].var(0), 0.25) for g in range(k)])
    model = Mixture(mean, deviation, np.full(k, 1 / k), prior_centre, prior_variance)
    before = -np.inf
    while True:  # until a step gains no more than GAIN

        def step(batches: Iterator[pa.RecordBatch], model: Mixture = model) -> Iterator[pa.RecordBatch]:
            n, s, q, like, count = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    z = model.standard(_stacked(batch))
                    p, log = model.posterior(z)
                    n, s, q, like, count = n + p.sum(0), s + p.T @ z, q + p.T @ z**2, like + log.sum(), count + len(z)
            at = np.indices((k, d), dtype=np.int32).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"k": at[0], "j": at[1], "n": np.repeat(n, d), "s": s.ravel(), "q": q.ravel(), "like": np.full(k * d, like), "rows": np.full(k * d, count)})

        sums = rows.select("x").mapInArrow(step, "k int, j int, n double, s double, q double, like double, rows long").groupBy("k", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "like", "rows")]).toPandas().sort_values(["k", "j"])
        if not len(sums) or not sums["rows"].iloc[0]:
            break
        n, s, q = sums["n"].to_numpy().reshape(k, d)[:, :1], sums["s"].to_numpy().reshape(k, d), sums["q"].to_numpy().reshape(k, d)
        pull = max(PRIOR_LEAST, PRIOR_SHARE * sums["rows"].iloc[0])
        centre = (s + pull * prior_centre) / (n + pull)
        variance = (q - 2 * centre * s + n * centre**2 + pull * (prior_variance + (prior_centre - centre) ** 2)) / (n + pull)
        model = Mixture(mean, deviation, (n[:, 0] + 1) / (n.sum() + k), centre, np.maximum(variance, LEAST_VARIANCE))
        like = sums["like"].iloc[0] / sums["rows"].iloc[0]
        if like - before < GAIN:
            break
        before = like
    held = model.posterior(z)[0]
    votes = np.array([held[kinds == i].sum(0) / max(1, (kinds == i).sum()) for i in range(len(KINDS))])
    return Mixture(model.mean, model.deviation, model.weights, model.centres, model.variances, tuple(KINDS[i] for i in votes.argmax(0)))


def _smoothed(p: np.ndarray) -> np.ndarray:
    """Each line's posterior, to three fifths its own, the rest that of the two lines before and after it."""
    if len(p) < 2:
        return p
    padded = np.pad(p, ((2, 2), (0, 0)))
    there = np.pad(np.ones((len(p), 1)), ((2, 2), (0, 0)))
    near = sum(padded[i : i + len(p)] for i in (0, 1, 3, 4)) / sum(there[i : i + len(p)] for i in (0, 1, 3, 4))
    return 0.6 * p + 0.4 * near


def shares(rows: DataFrame, model: Mixture) -> DataFrame:
    """doc_id and, for each kind, the share of the document's text in lines of that kind."""
    belongs = np.array([[kind == name for name in KINDS] for kind in model.kinds], dtype=float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, weights, x in zip(batch["doc_id"], batch["weights"], batch["x"], strict=True):
                p = _smoothed(model.posterior(model.standard(x.astype(float).reshape(-1, len(FEATURES))))[0] @ belongs)
                held = np.bincount(p.argmax(axis=1), weights=weights, minlength=len(KINDS))
                out.append((key, *(held / held.sum())))
            yield pd.DataFrame(out, columns=["doc_id", *KINDS])

    return rows.mapInPandas(assign, "doc_id long, " + ", ".join(f"{k} double" for k in KINDS))


def kinds(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, kind, and the share of each kind, of every document that has text."""
    common = words_of(common_words)
    rows = lines(documents, common)
    found = shares(rows, fit(rows, common))
    other = F.greatest(*KINDS[1:])
    return found.withColumn("kind", F.when(F.col("prose") >= 0.5, "prose").when(F.col("list") == other, "list").when(F.col("table") == other, "table").otherwise("junk"))


def found(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """p8_found: doc_id, kind of the documents that aren't natural prose."""
    return kinds(documents, common_words).where("kind <> 'prose'").select("doc_id", "kind")


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_share of each document.

    A word is a run of letters and digits; the symbol ratio is that of signs that are neither letters, digits nor blanks
    to all signs but blanks; blank lines don't count. Ratios of nothing are null.
    """
    common = sorted(words_of(common_words))
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in common or ["(?!)"]) + r")(?![\p{L}\p{N}])"
    lines_ = F.filter(F.split("text", r"\r?\n"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)
    rows = columns(documents, "doc_id", "text").select("doc_id", "text", words.alias("w"), lines_.alias("l"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("word_count"),
        (F.length(F.array_join("w", "")) / F.nullif(F.size("w"), F.lit(0))).alias("mean_word_length"),
        (F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")) / F.nullif(F.length(F.regexp_replace("text", r"\s", "")), F.lit(0))).alias("symbol_ratio"),
        (F.size(F.filter("l", lambda x: F.rtrim(x).rlike(r"[.!?…。！？]$"))) / F.nullif(F.size("l"), F.lit(0))).alias("punctuated_lines"),
        (F.size(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))) / F.nullif(F.size("w"), F.lit(0))).alias("common_share"),
    )
