import random
from datetime import datetime

from pyspark.sql import functions as F

from catalog import QUERIES, language, sessions
from catalog.base import Archive
from palaver.functions import text as tx
from palaver.functions.stopwords import STOPWORDS
from palaver.plans import groups as g, ingest, owner as o, persons as p, sessions as s_plans
from palaver.sources.schemas import RAW


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}


def test_star(star):
    assert {r["display_name"] for r in star["persons"].collect()} == {"Alice Smith", "Bob Jones"}
    assert star["messages"].count() == 8
    row = star["messages"].where("guid = 'g2'").first()
    assert row["response_seconds"] == 120.0 and row["has_attachment"] and row["person_id"] == 1
    assert star["messages"].where("guid = 'g8'").first()["person_id"] is None
    assert sorted((r["kind"], r["target_guid"]) for r in star["tapbacks"].collect()) == [("laugh", "g8"), ("love", "g2")]
    assert [r["emoji"] for r in star["emoji_uses"].collect()] == ["😂"]


def test_overrides(spark, raw):
    merge = spark.createDataFrame([("+15551234567", "Gym Buddy"), ("+15559990000", "Gym Buddy")], RAW["override_merge"])
    rename = spark.createDataFrame([("+15559990000", "Mom")], RAW["override_rename"])
    persons, handles = ingest.resolve_persons({**raw, "override_merge": merge})
    assert [tuple(r) for r in persons.collect()] == [(1, "Gym Buddy", "override")]
    assert {r["person_id"] for r in handles.collect()} == {1}
    persons, _ = ingest.resolve_persons({**raw, "override_rename": rename})
    assert sorted(r["display_name"] for r in persons.collect()) == ["Alice Smith", "Mom"]


def test_sessions_split_after_an_hour(spark):
    at = datetime(2024, 6, 1, 23, 30).timestamp
    rows = [(i, c, datetime.fromtimestamp(at() + 60 * m), bool(me), grp) for i, (c, m, me, grp) in enumerate(
        [(1, 0, 0, False), (1, 60, 1, False), (1, 61, 1, False), (1, 200, 0, False), (9, 0, 0, True), (9, 1, 1, True)])]
    df = spark.createDataFrame(rows, "msg_id long, chat_id int, ts_utc timestamp, is_from_me boolean, is_group boolean").withColumn(
        "ts_utc", F.col("ts_utc").cast("timestamp_ntz"))
    got = [(r["session_id"], r["response_seconds"]) for r in ingest.with_sessions(df).orderBy("msg_id").collect()]
    assert got == [("1:0", None), ("1:0", 3600.0), ("1:0", None), ("1:1", None), ("9:0", None), ("9:0", None)]


def test_leaderboard(star, flow):
    rows = as_dict(p.leaderboard(star, flow, "2024-06-03"), "display_name")
    a = rows["Alice Smith"]
    assert (a["total"], a["sent"], a["received"]) == (4, 2, 2)
    assert (a["median_response_seconds_me"], a["median_response_seconds_them"]) == (120.0, 300.0)
    assert (a["initiation_rate_me"], a["double_texts_me"], a["double_texts_them"]) == (0.5, 1, 0)
    assert (a["ghosts_by_them"], a["ghosts_by_me"], a["avg_session_seconds"], a["avg_session_messages"]) == (1, 1, 210.0, 2.0)
    assert a["streak_days"] == 2 and (rows["Bob Jones"]["total"], rows["Bob Jones"]["streak_days"]) == (1, 0)
    assert p.leaderboard(star, flow, "2026-01-01", 30).count() == 0


def test_person_queries(star, flow):
    assert [(r["bucket"], r["count"]) for r in p.monthly_timeline(star).where("display_name = 'Alice Smith'").collect()] == [("2024-06", 4)]
    days = {(r["person_id"], r["bucket"]): (r["sent"], r["received"]) for r in p.time_series(star, "day", True).collect()}
    assert days[(1, "2024-06-01")] == (1, 2) and days[(1, "2024-06-02")] == (1, 1)
    trend = {r["bucket"]: r for r in p.trends(star, flow, "day").where("person_id = 1").collect()}
    assert trend["2024-06-01"]["initiation_me"] == 0 and trend["2024-06-02"]["initiation_me"] == 1
    assert trend["2024-06-02"]["double_texts_me"] == 1
    assert {(r["weekday"], r["hour"]) for r in p.heatmap(star).where("person_id = 1").collect()} == {(6, 12), (0, 9)}
    text = p.day_transcripts(star, "2024-06-01").where("person_id = 1").first()["transcript"]
    assert text == "12:00 Alice Smith: hey 😂\n12:02 You: yo!"


def test_owner_queries(star, flow):
    assert [tuple(r) for r in o.overview_series(star["messages"], "day").collect()] == [("2024-06-01", 2, 4), ("2024-06-02", 1, 1)]
    assert o.totals(star).first()["sent_total"] == 3
    assert tuple(o.busiest_day(star["messages"]).first()) == ("2024-06-01", 2)
    assert tuple(o.reply_habits(flow).first()) == (1.0, 1)
    assert [(r["date"], r["count"]) for r in o.hot_days(star).collect()] == [("2024-06-01", 6), ("2024-06-02", 2)]
    assert [r["text"] for r in o.word_context(star["messages"], "SUP").collect()] == ["sup squad"]


def test_group_queries(star):
    row = g.leaderboard(star, "2024-07-01").first()
    assert (row["name"], row["total"], round(row["my_share"], 6)) == ("the squad", 3, 0.333333)
    assert {r["display_name"]: r["count"] for r in g.stats(star).collect()} == {"Alice Smith": 1, "Bob Jones": 1, "You": 1}
    you = g.member_stats(star).where("member_id = 0").first()
    assert (you["count"], you["sessions_total"], you["sessions_ended"]) == (1, 1, 1)
    assert [(r["kind"], r["member_id"]) for r in g.member_reactions(star).where("direction = 'given'").collect()] == [("laugh", 2)]


def test_shared_texts_are_kept_once(spark, tmp_path):
    """Events that say one document share its text: no message table holds texts, tables are written when read."""
    at = datetime(2024, 1, 3)
    events = [(i, at, 10 + i % 3, kind, 50.0 * (kind == "signup" and i > 90), '{"k": 1}')
              for i, kind in enumerate(["view", "click", "signup", "purchase", "error"] * 20)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, "hello there friend"), (1, ""), (2, "bye")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    archive = Archive.of(spark, str(tmp_path))
    assert archive.chats.count() == 1 and "messages" not in archive.star and "word_uses" not in archive.star
    assert "text" not in archive.messages.columns and "word_uses" not in archive.star
    got = {r["msg_id"]: (r["text"], r["char_len"], r["word_count"], r["emoji_count"]) for r in archive.said.collect()}
    assert len(got) == 78 and got[0] == ("hello there friend", 18, 3, 0) and got[1] == (" 😂", 2, 1, 1)
    assert got[2] == ("bye 🎉🎉", 6, 2, 2) and got[3] == (None, 0, 0, 0) and got[10] == (None, 0, 0, 0)
    raw = {r["msg_id"]: r for r in archive.raw["message"].collect()}
    assert len(raw) == 100 and raw[2]["text"] is None and raw[10]["text"] == "" and raw[1]["text"] == " 😂"
    uses = {(r["word"], r["count"]) for r in archive.word_uses.where("word = 'friend'").groupBy("word").sum("count").toDF("word", "count").collect()}
    assert uses == {("friend", sum((t or "").startswith("hello") for t, *_ in got.values()))}


def test_words_become_rows_where_they_are_counted(spark, star):
    """One row a message is shuffled; an author's words are dealt to several tasks when there are many messages."""
    rows = star["messages"].select("chat_id", "person_id", "is_from_me", F.date_format("ts_local", "yyyy").alias("year"), "text")
    want = {}
    for r in rows.where("text IS NOT NULL").collect():
        for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz'" else " " for c in r["text"].lower()).split(" "):
            if len(w) >= 3 and w not in STOPWORDS:
                key = (r["chat_id"], r["person_id"], r["is_from_me"], r["year"], w)
                want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:5]: r["count"] for r in star["word_uses"].collect()} == want
    dealt = ingest.word_uses(star, 1)
    found = [tuple(r) for r in dealt.collect()]
    assert {r[:5]: r[5] for r in found} == want and len(found) == len(want)
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.index("Generate explode(split(words") < plan.index("Exchange")


def _small_archive(spark, folder, texts, n=60):
    """Events of three people, one in a few minutes, that say the given documents in turn."""
    kinds = ["view", "click", "signup", "purchase", "error", "view"]
    events = [(i, datetime(2024, 1, 3, i // 12, i % 12 * 4), 10 + i % 3, kinds[i % 6], 1.0, '{"k": 1}') for i in range(n)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return Archive.of(spark, str(folder))


def test_people_are_not_worked_out_from_events_again(spark, tmp_path):
    raw = _small_archive(spark, tmp_path, ["hello there"]).raw
    for name in ("handle", "contact", "contact_phone", "contact_email"):
        assert raw[name].count() and not any("events.parquet" in f for f in raw[name].inputFiles()), name


def test_facts_of_shared_texts(spark):
    """Facts of a text with a tail are those of both joined, also where an emoji or a word reaches over the border; texts are not shuffled."""
    texts = [None, "", "  ", " hi there  ", "\n", "👍", "a 1", "so ", "ends 🇩", "x" * 50]
    tails = [None, "", " ", " 😂", " 🎉🎉 ", "🏽", "🇪 y", "word", "️⃣"]
    scan = spark.createDataFrame(list(enumerate(texts)), "text_key long, text string")
    raw = {"text_scan": scan, "message_row": spark.createDataFrame([(t,) for t in tails], "text_tail string")}
    facts = ingest.text_facts(raw)
    both = spark.createDataFrame([(k, a, t, a + t or None) for k, a in enumerate(texts) if a is not None for t in tails if t is not None],
                                 "text_key long, a string, text_tail string, text string")
    trimmed = F.trim(F.concat("a", "text_tail"))
    want = both.withColumns({**tx.text_stats(F.col("text")), "size": F.char_length(trimmed), "said": F.unhex(F.md5(trimmed))})
    columns = ["text_key", "text_tail", "char_len", "word_count", "emoji_count", "size", "said"]
    got = {tuple(r) for r in facts.select(columns).collect()}
    blank = {(0, t, 0, 0, 0, 0, None) for t in tails if t is not None}
    assert got == {tuple(r) for r in want.select(columns).collect()} | blank
    assert "Exchange" not in facts._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_hashes_of_transcripts_write_no_texts(spark, tmp_path):
    archive = _small_archive(spark, tmp_path, ["some words said by everyone here", "a", "  more of them now  "])
    rows = {r["session_id"]: r["text_hash"] for r in QUERIES["x14_transcript_hash"](spark, str(tmp_path)).collect()}
    assert rows and "transcripts" not in archive.__dict__["_kept"]
    assert rows == {r["session_id"]: r["text_hash"] for r in sessions.transcripts(archive).collect()}


def test_transcripts_read_what_shows(spark):
    """Clipped by lengths alone as if all texts were joined; texts of lines that do not show need not exist."""
    rng, rows, texts, want = random.Random(4), [], {}, {}
    for s in range(60):
        lines, names = [], [None, " ", "Ann Lee", "Bartholomew"]
        for i in range(rng.choice([3, 8, 40])):
            size = rng.choice([1, 5, 300, 1200, 3990, 3993, 3995, 3996, 5000])
            body = "".join(rng.choice("ab 😂\n") for _ in range(size))
            key, tail, mine, sender = len(texts), rng.choice(["", " 😂", " "]), rng.random() < 0.5, rng.choice(names)
            text = ((" " * rng.choice([0, 3]) + body) + tail).strip(" ")
            if not text:
                continue
            lines.append(("Me" if mine else "Them", "Me" if mine else (sender or "").split(" ")[0] or "Them", text))
            texts[key] = (" " * rng.choice([0, 3]) + body, sum(len(x[0]) + len(x[2]) + 3 for x in lines[:-1]) <= 4000
                          or sum(len(x[1]) + len(x[2]) + 3 for x in lines[:-1]) <= 4000)
            rows.append((str(s), i, i, mine, sender, len(text), key, tail, text))
        want[str(s)] = tuple("\n".join(f"{x[w]}: {x[2]}" for x in lines)[:4000] for w in (0, 1))
    exact = "x" * (4000 - len("Me: \n"))  # the break behind this line is the last character
    rows += [("edge", 0, 0, True, None, len(exact), len(texts), "", exact), ("edge", 1, 1, True, None, 3, len(texts) + 1, "", "end")]
    texts |= {len(texts): (exact, True), len(texts) + 1: ("end", True)}
    want["edge"] = (f"Me: {exact}\n",) * 2
    df = spark.createDataFrame(rows, "session_id string, msg_id long, ts_utc long, is_from_me boolean, sender string, size int, "
                                     "text_key long, text_tail string, text string")
    docs = df.select("session_id").distinct()
    shown = spark.createDataFrame([(k, t) for k, (t, shows) in texts.items() if shows], "text_key long, text string")
    for got in (s_plans.transcripts(df.drop("text"), docs, shown), s_plans.transcripts(df.drop("text_key", "text_tail"), docs)):
        found = {r["session_id"]: (r["conv_text"], r["disp_text"]) for r in got.collect()}
        assert found == want and any(not shows for _, shows in texts.values())


def test_messages_are_numbered_by_text_without_texts(spark, tmp_path):
    archive = _small_archive(spark, tmp_path, ["one two", " one two ", None, "", "three"])
    named = {r["msg_id"]: r["text_id"] for r in language.said(archive).collect()}
    assert "texts" not in archive.__dict__["_kept"]
    first, want = {}, {}
    for r in archive.said.orderBy("msg_id").collect():
        text = (r["text"] or "").strip(" ")
        if text:
            want[r["msg_id"]] = first.setdefault(text, r["msg_id"])
    assert named == want and len(set(want.values())) < len(want)
    assert {(r["text"], r["text_id"]) for r in language.texts(archive).collect()} == set(first.items())
