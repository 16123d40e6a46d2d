"""Adaptive quality rules against plain counting."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kinelake.llm import quality_rules
from kinelake.llm.quality_rules import KEYS, PRIOR, RULES, SPREADS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COUNTS = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), len(lines), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def brute(rows):
    found, own, language = [], defaultdict(list), defaultdict(list)
    for i, text, lang, source, _ in rows:
        c = dict(zip(COUNTS, counts(text)))
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        shares = {r.name: 1000 * c[r.part] // max(c[r.whole], 1) for r in RULES}
        found.append((i, lang, source, c, failed, shares))
        if not failed:
            for name, v in shares.items():
                bits = max(v.bit_length() - 6, 0)
                own[lang, source, name].append(v >> bits << bits)
                language[lang, name].append(v >> bits << bits)
    quantile = lambda values, part: sorted(values)[-(-part * len(values) // 4) - 1]
    out = []
    for i, lang, source, c, failed, shares in found:
        kept = not failed
        for r in RULES:
            if failed:
                break
            a, b = own[lang, source, r.name], language[lang, r.name]
            low, high = ((len(a) * quantile(a, p) + PRIOR * quantile(b, p)) // (len(a) + PRIOR) for p in (1, 3))
            kept &= shares[r.name] <= high + SPREADS * (high - low) + r.slack
        out.append((i, *(c[k] for k in COUNTS), failed, kept))
    return sorted(out, key=str)


def documents():
    rng, rows = random.Random(2), []
    word = lambda k=6: "".join(rng.choice("abcdéfüж") for _ in range(rng.randint(2, k)))
    for i in range(240):
        words = [word(6 if i % 5 else 14) for _ in range(rng.randint(45, 150))]
        if i % 7 == 0:
            words[10:10] = words[20:40]
        if i % 11 == 0:
            words = [w + "#$%" for w in words]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t ", " \r\n"]) for w in words)
        rows.append(text + ("\nsame line\n" * rng.randint(0, 30) if i % 13 == 0 else ""))
    rows += [None, "", " \n\t", "one", "a b c a b c a b c", "x " * 5000, " ".join(word() for _ in range(20000)), "\x1f   \x0b|", "a\u0085b"] + rows[:2]
    out = [(i, t, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", None, ""]), 0) for i, t in enumerate(rows)]
    return out + [out[5], out[5], (None, rows[3], None, None, None)]


def test_counts_and_verdicts_follow_brute_force(spark):
    clash = [c for c in (*KEYS, "n", "words", "kept", "low", "total", "length", "value", "rule")]
    df = spark.createDataFrame(documents(), SCHEMA).withColumns({c: F.lit("x") for c in clash}).repartition(3)
    got = quality_rules.filtered(df).select("doc_id", *COUNTS, "base_failed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(documents())
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_sketches_of_parts_merge_to_the_whole(spark):
    keys = ["lang_key"]
    rows = spark.range(3000).select(F.lit("en").alias("lang_key"), (F.col("id") % 3).alias("part"), *((F.col("id") * 37 % 5000).alias(r.name) for r in RULES))
    parts = quality_rules.merged(quality_rules.sketches(rows, ["lang_key", "part"]), keys)
    whole = quality_rules.sketches(rows, keys)
    assert sorted(parts.collect()) == sorted(whole.collect())
    exact = sorted(i * 37 % 5000 for i in range(3000))
    for q in quality_rules.quartiles(whole, keys).collect():
        assert exact[749] * 31 / 32 <= q.low <= exact[749] and exact[2249] * 31 / 32 <= q.high <= exact[2249]


def test_plan_has_no_python(spark):
    rows = quality_rules.filtered(spark.createDataFrame(documents(), SCHEMA))
    stats = quality_rules.statistics(spark.createDataFrame(documents(), SCHEMA))
    for df in (rows, stats):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_no_documents(spark):
    assert quality_rules.filtered(spark.createDataFrame([], SCHEMA)).count() == 0
