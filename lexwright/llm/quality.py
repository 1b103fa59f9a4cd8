"""Quality rules as weak supervision.

No Python runs on the executors.  Rules vote for, against or not at all; the votes
are counted by pattern (at most 3**rules rows, whatever the corpus), expectation
maximisation over these counts estimates how often each rule votes against good and bad
texts, and the posterior quality probability, a logistic sum over the votes, decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of every whole text. Null and wordless texts count 0 throughout."""
    kept = [c for c in docs.columns if c == text or c not in MEASURES]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.trim(F.regexp_replace(t, SPACE, " ")).alias("__line"))
    d = d.withColumn("__words", F.when(F.col("__line") != "", F.split("__line", " ")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    starts = F.sequence(F.lit(0), F.size("__words") - 3)
    hashes = F.transform(starts, lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")))
    d = d.withColumn("__grams", F.when(F.col("n_words") >= 4, F.sort_array(hashes)))
    # a window is repeated if a neighbour in hash order is the same
    same = lambda x, j: F.coalesce(F.get("__grams", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__grams", j + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("__twice", F.transform(F.filter("__grams", same), lambda x: x["i"]))
    covered = F.array_distinct(F.concat("__twice", F.transform("__twice", lambda i: i + 1), F.transform("__twice", lambda i: i + 2)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return d.withColumns(
        {
            "word_chars": (F.length("__line") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"),
            "n_symbols": (F.octet_length(t) - F.octet_length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
        }
    ).select(*[F.col(f"`{c}`") for c in kept], *MEASURES)


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains). What most texts are like anyway is no vote."""
    vote = lambda bad, good=None: F.when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)
    n, chars, symbols, lines, repeats = (F.col(c) for c in MEASURES)
    return {
        "length": vote(n < 50, n >= 100),
        "word_size": vote((chars < 2 * n) | (chars > 15 * n), chars.between(3 * n, 10 * n)),
        "symbols": vote(10 * symbols > n),
        "dup_lines": vote(lines * 60 > n),
        "repeats": vote(4 * repeats > n, 100 * repeats <= n),
    }


#: What is taken to hold before anything is seen, and its weight as a share of the rows, so that it weighs the same at every
#: size: the share of good texts, how often a rule votes against a good and a bad text, and for one that it doesn't vote
#: against.  That rules seldom vote against good texts holds the hidden label to its meaning, so it weighs
#: much; the rest is learned.
PRIOR = (0.9, 1.0)
AGAINST = ((0.005, 5.0), (0.3, 0.01))
FAVOUR = ((0.6, 0.01), (0.4, 0.01))

#: (P(against | good), P(against | bad)), (P(for | good, not against), P(for | bad, not against)) of a rule
Accuracy = tuple[tuple[float, float], tuple[float, float]]


def fit(counts: dict[tuple[int, ...], int], rounds: int = 200, starts: tuple[float, ...] = (0.9, 0.7, 0.97)) -> tuple[float, list[Accuracy]]:
    """EM for one hidden binary label: the share of good texts, and each rule's accuracies in both classes.

    Of several starts the one with the best posterior density is taken.  Beliefs weigh as shares
    of the rows, so rules that often agree can't take the label over, and one that no other
    rule ever joins isn't explained away.  Without rows the beliefs stay.
    """
    k, total = len(next(iter(counts), ())), sum(counts.values())
    best = None
    for start in starts:
        prior, seen, gain = start, [(tuple(p for p, _ in AGAINST), tuple(p for p, _ in FAVOUR))] * k, -math.inf
        for _ in range(rounds):
            now = total * _log_belief(prior, PRIOR) + sum(total * _log_belief(held[i][y], belief[y]) for held in seen for i, belief in enumerate((AGAINST, FAVOUR)) for y in (0, 1))
            mass, against, favour = [0.0, 0.0], [[0.0, 0.0] for _ in range(k)], [[0.0, 0.0] for _ in range(k)]
            for votes, n in sorted(counts.items()):
                logs = [math.log(c) + sum(math.log(_chance(held, v, y)) for held, v in zip(seen, votes)) for y, c in enumerate((prior, 1 - prior))]
                top = max(logs)
                shares = [math.exp(x - top) for x in logs]
                now += n * (top + math.log(sum(shares)))
                for y, share in enumerate(shares):
                    m = n * share / sum(shares)
                    mass[y] += m
                    for j, v in enumerate(votes):
                        against[j][y] += m * (v < 0)
                        favour[j][y] += m * (v > 0)
            if now <= gain + 1e-9 * abs(gain):
                break
            gain = now
            prior = _mean(mass[0], total, PRIOR, total)
            seen = [
                (tuple(_mean(a[y], mass[y], AGAINST[y], total) for y in (0, 1)), tuple(_mean(f[y], mass[y] - a[y], FAVOUR[y], total) for y in (0, 1)))
                for a, f in zip(against, favour)
            ]
        if best is None or gain > best[0]:
            best = gain, prior, seen
    return best[1:]


def _mean(hits: float, of: float, belief: tuple[float, float], total: float) -> float:
    p, weight = belief[0], belief[1] * total + 1
    return (hits + p * weight) / (of + weight)


def _log_belief(p: float, belief: tuple[float, float]) -> float:
    return belief[1] * (belief[0] * math.log(p) + (1 - belief[0]) * math.log(1 - p))


def _chance(held: Accuracy, vote: int, y: int) -> float:
    against, favour = held[0][y], held[1][y]
    return against if vote < 0 else (1 - against) * (favour if vote > 0 else 1 - favour)


def evidence(held: Accuracy, vote: int) -> float:
    """What a vote adds to the log odds of a good text; a rule never counts against its own meaning."""
    e = math.log(_chance(held, vote, 0) / _chance(held, vote, 1))
    return min(0.0, e) if vote < 0 else max(0.0, e) if vote > 0 else e


def log_odds(votes, prior: float, seen) -> float:
    return math.log(prior / (1 - prior)) + sum(evidence(held, v) for held, v in zip(seen, votes))


def posterior(votes, prior: float, seen) -> float:
    return 1 / (1 + math.exp(-log_odds(votes, prior, seen)))


def judge_quality(docs: DataFrame, text: str = "text", keep: float = 0.5) -> DataFrame:
    """Add the base counts, base_failed, quality (posterior probability) and kept to every row.

    base_failed (under 50 words, or over half of the words in repeated 3-word windows)
    overrules the posterior.  The measures are written to the scratch folder once, so the
    texts are read once.  An empty table gives no rows; columns of these names are replaced.
    """
    new = ("base_failed", "quality", "kept")
    names = list(rules())
    m = written(measured(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c not in new]), text).drop(text), "quality")
    voted = m.select("*", *[c.alias(f"__{n}") for n, c in rules().items()])
    counted = voted.groupBy(*[f"__{n}" for n in names]).count().collect()  # at most 3**len(rules) rows
    prior, seen = fit({tuple(r[:-1]): r[-1] for r in counted})
    odds = F.lit(math.log(prior / (1 - prior)))
    for n, held in zip(names, seen):
        odds = odds + F.when(F.col(f"__{n}") > 0, evidence(held, 1)).when(F.col(f"__{n}") < 0, evidence(held, -1)).otherwise(evidence(held, 0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)).drop(*[f"__{n}" for n in names])
