"""Rules for suspicious translations on literal pairs, each with its reason."""

import pytest
from pyspark.sql import functions as F

from tidecue.functions import qa

PROSE = "these are ten plain english words in one long sentence"
CASES = [
    ("hello", " ", ["empty translation"]),
    ("hello", '[{"id": "1", "translation": "x"}]', ["json or markdown leak"]),
    ("hello", "I'm sorry, no", ["model refusal"]),
    ("hello", "Note: hello", ["polluted output"]),
    ("see http://a.test now", "看", ["url count mismatch"]),
    ("it took 5 seconds", "花了 5 秒", []),
    ("it took 5 seconds", "花了 5 分钟", ["unit token mismatch"]),
    ("open C:\\a\\b", "打开", ["path token mismatch", "code token loss"]),
    ("plain", "plain 5", []),
    ("[[ a", "a", ["bracket count mismatch"]),
    (PROSE, "没有", ["unusually short"]),
    (PROSE, "nothing of that script but long enough", ["missing target-language characters"]),
    (PROSE + " --now", "好", ["option token mismatch", "code token loss", "unusually short"]),
]


@pytest.mark.parametrize("source, translation, want", CASES)
def test_issues(spark, source, translation, want):
    df = spark.createDataFrame([(source, translation)], "s string, t string")
    assert df.select(qa.issues(F.col("s"), F.col("t"), "zh").alias("r")).first().r == want
