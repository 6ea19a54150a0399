import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import chat


def test_roles_of_held_out_conversations(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = chat.raw_transcripts(talks).cache()
    held = F.crc32(F.col("conv").cast("string")) % 3 == 1
    model = chat.learn(lines.where(~held))
    got = chat.decode(lines.where(held).withColumnRenamed("state", "truth"), model)
    n, role, turn = got.agg(F.count("*"), F.sum((F.floor(F.col("state") / 2) == F.floor(F.col("truth") / 2)).cast("int")), F.sum((F.col("state") == F.col("truth")).cast("int"))).first()
    assert n > 200 and role / n > 0.9 and turn / n > 0.85
    marked = chat.render(got).where("content rlike '^(?i)(user|human|assistant|ai|system):'").count()
    assert marked == 0


def brute(obs, model):
    score, best = model.start + model.emit[:, obs[0]], [[s] for s in range(chat.STATES)]
    for o in obs[1:]:
        nxt = []
        for s in range(chat.STATES):
            k = int(np.argmax(score + model.step[:, s]))
            nxt.append((score[k] + model.step[k, s] + model.emit[s, o], best[k] + [s]))
        score, best = np.array([x for x, _ in nxt]), [p for _, p in nxt]
    return best[int(score.argmax())], score.max()


def test_chunks_give_the_whole_transcripts_path(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), size=s[:-1] or None))
    model = chat.ChatModel(p(chat.STATES), p(chat.STATES, chat.STATES), p(chat.STATES, chat.OBSERVATIONS))
    monkeypatch.setattr(chat, "CHUNK", 7)
    texts = {k: "\n".join(rng.choice(["User: x?", "AI: y", "", "z" * 100, "plain"], size=n)) for k, n in enumerate((1, 6, 7, 8, 40))}
    df = spark.createDataFrame(list(texts.items()), "conv_id long, text string")
    lines = chat.to_lines(df)
    obs = {(r["conv"], r["at"]): r["obs"] for r in chat.observe(lines).collect()}
    got = {(r["conv"], r["at"]): r["state"] for r in chat.decode(lines, model).collect()}
    for k, t in texts.items():
        n = t.count("\n") + 1
        own = [obs[k, i] for i in range(n)]
        path, score = brute(own, model)
        mine = [got[k, i] for i in range(n)]
        total = model.start[mine[0]] + model.emit[mine[0], own[0]] + sum(model.step[a, b] + model.emit[b, o] for a, b, o in zip(mine, mine[1:], own[1:]))
        assert total == pytest.approx(score) and mine == path


def test_edges(spark):
    talks = spark.createDataFrame([(1, 0, "user", "Hi?"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "narrator", "x"), (4, 0, "user", "a\nb"), (4, 0, "user", "a\nb")], "conv_id long, turn long, role string, text string")
    lines = chat.raw_transcripts(talks)
    assert {r["conv"] for r in lines.collect()} == {1, 2, 3, 4}
    assert chat.learn(lines).step.shape == (chat.STATES, chat.STATES)
    model = chat.learn(chat.raw_transcripts(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    raw = spark.createDataFrame([(1, "User: Hi?\nAssistant: Hello.\nMore."), (2, None), (3, ""), (None, "User: x"), (5, "User: " + "long " * 50_000)], "conv_id long, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["content"]) for r in chat.format_transcripts(raw, model).collect()}
    assert got[1, 0] == ("user", "Hi?") and (3, 0) in got and got[5, 0][0] == "user" and {k for k, _ in got} == {1, 3, 5}
    assert chat.format_transcripts(raw.limit(0), model).count() == 0
    assert chat.learn(lines.limit(0)).start.shape == (chat.STATES,)


def test_turns_of_held_out_conversations(spark):
    """The query's own turns against those that the transcripts were made of."""
    from reelspan.llm.queries import op10_chat_turns

    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = op10_chat_turns(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    body = got["rendered"].str.removesuffix("\n<|end|>").str.split("|>\n", n=1, regex=False).str[1]
    found = {(i, r, " ".join(t.split())) for i, r, t in zip(got["conv_id"], got["role"], body, strict=True)}
    true = talks.where(F.crc32(F.col("conv_id").cast("string")) % 3 == 1).toPandas()
    hit = [(i, r, " ".join((t or "").split())) in found for i, r, t in zip(true["conv_id"], true["role"], true["text"], strict=True)]
    assert len(hit) > 150 and np.mean(hit) > 0.85, np.mean(hit)


def test_every_role_and_every_turn_is_kept(spark):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "tool", "42"), (1, 2, "assistant", "It is 42."), (1, None, None, "late"), (1, 2, "assistant", "It is 42.")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat.raw_transcripts(talks)
    begins = lines.where("state % 2 = 0").orderBy("at").collect()
    assert [r["state"] // 2 for r in begins] == [1, 3, 2, 2, 3] and begins[-1]["line"].endswith("late")
    model = chat.learn(chat.raw_transcripts(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).unionByName(lines))
    raw = spark.createDataFrame([(1, "User: Hi?\nTool: 42\nAssistant: It is 42.")], "conv_id long, text string")
    got = [(r["role"], r["content"]) for r in chat.format_transcripts(raw, model).orderBy("turn").collect()]
    assert got == [("user", "Hi?"), ("other", "42"), ("assistant", "It is 42.")]
    assert chat.render(chat.decode(chat.to_lines(raw.limit(0)), model)).count() == 0
