import pytest
from pyspark.sql import functions as F

from spanmill.functions import genai, labels, pii, sampling, text, times
from spanmill.operators import pii as pii_operator


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("raw, name", [
    ("meta-llama/Llama-3.1-8B-Instruct", "llama-3.1-8b"),
    ("claude-3-5-sonnet-20241022", "claude-3.5-sonnet"),
    ("claude-3.5-sonnet-20241022", "claude-3.5-sonnet"),
    ("gpt-4o-2024-08-06", "gpt-4o"),
    ("llama-3-1-8b", "llama-3-1-8b"),
    ("o1", "o1"),
])
def test_canonical_model(spark, raw, name):
    assert one(spark, m=genai.canonical_model(F.lit(raw))).m == name


@pytest.mark.parametrize("payload, expected", [
    ('{"usage":{"prompt_tokens":12,"completion_tokens":32,"total_tokens":44}}', (12, 32, 44)),
    ('{"usage":{"input_tokens":15,"output_tokens":38}}', (15, 38, 53)),
    ('{"usage_metadata":{"prompt_token_count":7,"candidates_token_count":5}}', (7, 5, 12)),
    ('{"usage_metadata":{"prompt_token_count":7}}', (7, 0, 7)),
    ("{}", (0, 0, 0)),
    ("not json", (0, 0, 0)),
])
def test_usage_dialects(spark, payload, expected):
    assert tuple(one(spark, **genai.usage_columns(F.lit(payload)))) == expected


@pytest.mark.parametrize("body, kinds, score, flagged", [
    ("Use 219-09-9999 on the form, answers go to kim.lee@mail.example.org", ["ssn", "email"], 0.6, True),
    ("Nothing in this sentence needs a second look.", [], 0.0, False),
    ("The number we hold for you reads 219-09-9999, is that right?", ["ssn"], 0.3, False),
    ("call 5551234567", ["phone"], 0.3, False),
    ("a@b.c|x", ["email"], 0.3, False),
    ("1-2-3 " * 3 + "123-45-6789 " * 5, ["ssn"] * 5, 1.0, True),
    ("", [], 0.0, False),
])
def test_pii(spark, body, kinds, score, flagged):
    items = pii.pii_items(F.lit(body))
    row = one(spark, items=items, score=pii.pii_score(items), flag=pii.needs_triage(items))
    assert [i.type for i in row["items"]] == kinds
    assert row.score == pytest.approx(score)
    assert row.flag is flagged


def test_pii_always_flag_and_null(spark):
    items = pii.pii_items(F.lit("123-45-6789"))
    assert one(spark, f=pii.needs_triage(items, always_flag=("ssn",))).f
    assert one(spark, i=pii.pii_items(F.lit(None).cast("string")))["i"] == []


def test_word_break_is_unicode(spark):
    # A letter before the digits is no word break, accented or not.
    assert one(spark, i=pii.pii_items(F.lit("é123-45-6789")))["i"] == []


@pytest.mark.parametrize("number, valid", [
    ("4539578763621486", True), ("4111111111111111", True), ("4111111111111112", False), ("378282246310005", True),
])
def test_luhn(spark, number, valid):
    found = one(spark, c=pii.card_numbers(F.lit(f"card {number}."))).c
    assert found == ([number] if valid else [])


def test_hash_sample_is_repeatable_and_near_its_rate(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    kept = keys.filter(sampling.hash_keep("k", 0.1, "x"))
    n = kept.count()
    assert 1_800 < n < 2_200
    assert kept.exceptAll(keys.filter(sampling.hash_keep("k", 0.1, "x"))).count() == 0
    assert keys.filter(sampling.hash_keep("k", 1.0)).count() == 20_000
    assert keys.filter(sampling.hash_keep("k", 0.0)).count() == 0


@pytest.mark.parametrize("score, level", [(0.26, "critical"), (0.25, "warning"), (0.2, "normal"), (None, "normal")])
def test_psi_level_is_strict(spark, score, level):
    assert one(spark, l=labels.psi_level(F.lit(score).cast("double"))).l == level


def test_text_forms(spark):
    row = one(
        spark, money=labels.money(F.lit(1.5)), none=labels.fixed(F.lit(None), 1),
        grouped=labels.grouped(F.lit(1234567)), words=text.tokens(F.lit("Ein Wörtchen, ein WORT!")),
        sentences=text.sentences(F.lit("One. ... Two?\nThree")),
    )
    assert (row.money, row.none, row.grouped) == ("$1.5000", "0.0", "1,234,567")
    assert row.words == ["ein", "wörtchen", "ein", "wort"]
    assert [s.strip() for s in row.sentences] == ["One", "Two", "Three"]


def test_within_bounds(spark):
    rows = spark.sql(
        "SELECT timestamp(t) AS t FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-01 00:04:59'), "
        "('2024-01-01 00:05:00'), ('2023-12-31 23:59:59') AS v(t)")
    kept = rows.filter(times.within("t", "2024-01-01 00:05:00", minutes=5)).count()
    assert kept == 2


def test_tick_is_the_end_of_its_step(spark):
    ts = F.lit("2024-01-01 00:00:15").cast("timestamp")
    assert one(spark, t=times.tick_of(ts, 15), e=F.unix_seconds(ts)).asDict() == {"t": 1704067230, "e": 1704067215}


REDACTED = {
    "Your SSN is 123-45-6789 and email is test@example.com": ("Your SSN is *********** and email is ****************", 2),
    "overlap: 123-45-6789@mail.example.org.": ("overlap: ****************************.", 1),
    "é😀 123-45-6789\tü\n5551234567": ("é😀 ***********\tü\n**********", 2),
    "12345-123-45-6789 is none, a@b is none": ("12345-*********** is none, a@b is none", 1),
    "": ("", 0),
    "no match\n\n  at all ": ("no match\n\n  at all ", 0),
}


def test_redact_masks_maximal_runs_in_place(spark):
    rows = [(k, *pair) for k, pair in enumerate(REDACTED.items())]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(99, None)], "id int, response string")
    got = {r["id"]: (r["response"], r["pii_runs"]) for r in pii_operator.redact(docs).collect()}
    assert got == {**{k: wanted for k, _, wanted in rows}, 99: (None, 0)}
    kept = pii_operator.redact(docs, out="clean", mask="#").first()
    assert kept["response"] == rows[0][1] and kept["clean"].count("#") == 27


def test_redact_takes_cards_and_very_long_texts(spark):
    text = "card 4111111111111111 none 4111111111111112 " * 2 + "padding " * 300_000 + "kim@example.org"
    row = pii_operator.redact(spark.createDataFrame([(text,)], "response string"), cards=True).first()
    assert row["pii_runs"] == 3 and len(row["response"]) == len(text)
    assert "4111111111111111" not in row["response"] and row["response"].endswith(" " + "*" * 15) and "4111111111111112" in row["response"]
