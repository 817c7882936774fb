"""The loss that op9 reports is what its mask covers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from verdictflow.llm import chat

TURNS = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "one </turn> \\ two\n\U0001f600"), (1, 2, "assistant", ""), (1, 3, "a:b", None), (1, 4, "assistant", "<|x|> end"), (2, 0, "user", "only")]


def rows(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    return chat.read_back(chat.format_conversations(turns, chat.text_part(F.col("text"))))


def test_loss_is_the_text_under_the_mask(spark):
    got = {r.conv_id: r for r in chat.digest(rows(spark)).collect()}
    wanted = "".join(t or "" for c, _, r, t in TURNS if c == 1 and r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(wanted), hashlib.sha256(wanted.encode()).hexdigest())
    assert got[2].loss_chars == 0


def test_another_mask_gives_another_loss(spark):
    turned = rows(spark).withColumn("loss_runs", F.transform("loss_runs", lambda r, i: F.struct(r["chars"].alias("chars"), ((i % 3 == 1) & ~r["loss"]).alias("loss"))))
    got = {r.conv_id: r for r in chat.digest(turned).collect()}
    wanted = "".join(t or "" for c, _, r, t in TURNS if c == 1 and r != "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(wanted), hashlib.sha256(wanted.encode()).hexdigest())
    assert got[2].loss_chars == len("only")


def test_runs_that_do_not_fit_are_an_error(spark):
    for wrong in (F.transform("loss_runs", lambda r: F.struct((r["chars"] + 1).alias("chars"), r["loss"].alias("loss"))), F.slice("loss_runs", 1, 2)):
        with pytest.raises(Exception, match="loss_runs do not fit"):
            chat.digest(rows(spark).withColumn("loss_runs", wrong)).collect()
