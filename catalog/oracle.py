"""Check SQL for DuckDB: the driver tables read as a message archive, as named tables."""
from __future__ import annotations

import re

from palaver.functions.stopwords import STOPWORDS
from palaver.functions.text import EMOJI, WHITESPACE

AS_OF = "2024-01-31 00:00:00"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_LIST = ", ".join(quote(w) for w in STOPWORDS)
FOLDED = "replace(lower(text), '’', '''')"

TABLES: dict[str, str] = {
    "ev": """
        SELECT *, user_id // 10 AS c, (user_id // 10) % 3 = 2 AS grp,
               CASE WHEN (user_id // 10) % 3 = 2
                    THEN 3 * ((user_id % 10) // 2) + user_id % 2 + 1
                    ELSE user_id // 10 + 1 END AS peer,
               event_type IN ('click', 'view')
                 OR (event_type = 'error' AND event_id % 2 = 0) AS mine
        FROM events""",
    "raw_rows": """
        SELECT event_id AS msg_id, 'g' || event_id AS guid, c + 1 AS chat_id, grp, peer, mine, ts, value,
               event_type,
               CASE WHEN event_type = 'error' THEN 2000 + event_id % 7 ELSE 0 END AS code,
               CASE WHEN event_type = 'signup' AND value >= 50 THEN 2 ELSE 0 END AS item,
               CASE WHEN event_type = 'purchase' THEN NULL
                    ELSE d.text || CASE event_type WHEN 'click' THEN ' 😂' WHEN 'signup' THEN ' 🎉🎉' ELSE '' END
               END AS text
        FROM ev JOIN documents d ON d.doc_id = ev.event_id % (SELECT count(*) FROM documents)""",
    "people": """
        SELECT peer, dense_rank() OVER (ORDER BY peer) AS person_id,
               CASE WHEN peer % 13 = 0 THEN 'urn:biz:' || peer ELSE 'Person ' || peer END AS display_name,
               CASE WHEN peer % 13 = 0 THEN 'unmatched' ELSE 'contacts' END AS source
        FROM (SELECT DISTINCT peer FROM ev)""",
    "persons": "SELECT person_id, display_name, source FROM people",
    "chat_members": """
        SELECT DISTINCT ev.c + 1 AS chat_id, p.person_id FROM ev JOIN people p USING (peer)""",
    "chats": """
        SELECT chat_id, grp AS is_group, n AS participant_count,
               CASE WHEN grp THEN CASE WHEN chat_id % 4 = 0 THEN '' ELSE 'group-' || chat_id END END AS name
        FROM (SELECT DISTINCT c + 1 AS chat_id, grp FROM ev)
        JOIN (SELECT chat_id, count(*) AS n FROM chat_members GROUP BY 1) USING (chat_id)""",
    "base_rows": """
        SELECT r.msg_id, r.guid, r.chat_id, r.grp, r.mine AS is_from_me, r.ts AS ts_utc, r.ts AS ts_local, r.text,
               CASE WHEN r.mine AND r.grp THEN NULL ELSE p.person_id END AS person_id,
               r.event_type = 'purchase' AS has_attachment, r.value >= 100 AS is_audio
        FROM raw_rows r JOIN people p USING (peer)
        WHERE r.code = 0 AND r.item = 0""",
    "messages": f"""
        SELECT msg_id, guid, chat_id, person_id, is_from_me, ts_utc, ts_local, text, has_attachment, is_audio, grp,
               chat_id || ':' || no AS session_id,
               CASE WHEN NOT grp AND gap <= 3600000000 AND before <> is_from_me THEN gap / 1e6 END AS response_seconds,
               coalesce(length(text), 0) AS char_len,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITESPACE}'), lambda w: w <> '')) AS word_count,
               len(regexp_extract_all(coalesce(text, ''), '{EMOJI}', 1)) AS emoji_count
        FROM (SELECT *, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY chat_id ORDER BY ts_utc, msg_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS no
              FROM (SELECT *, epoch_us(ts_utc) - epoch_us(lag(ts_utc) OVER w) AS gap, lag(is_from_me) OVER w AS before
                    FROM base_rows WINDOW w AS (PARTITION BY chat_id ORDER BY ts_utc, msg_id)))""",
    "tapbacks": """
        SELECT 'g' || (r.msg_id - 1) AS target_guid, CASE WHEN r.mine THEN NULL ELSE p.person_id END AS person_id,
               r.mine AS is_from_me, r.ts AS ts_utc, r.msg_id,
               CASE r.code WHEN 2000 THEN 'love' WHEN 2001 THEN 'like' WHEN 2002 THEN 'dislike'
                           WHEN 2003 THEN 'laugh' WHEN 2004 THEN 'emphasize' ELSE 'question' END AS kind
        FROM raw_rows r JOIN people p USING (peer) WHERE r.code BETWEEN 2000 AND 2005""",
    "attachments": """
        SELECT event_id AS msg_id, floor(value * 100)::BIGINT AS total_bytes,
               CASE json_extract_string(props, '$.k')::INT % 3
                    WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' ELSE 'application/pdf' END AS mime_type
        FROM ev WHERE event_type = 'purchase'""",
    "emoji_uses": f"""
        SELECT msg_id, unnest(regexp_extract_all(text, '{EMOJI}', 1)) AS emoji FROM base_rows WHERE text IS NOT NULL""",
    "dm": """
        SELECT m.*, cm.person_id AS contact_id
        FROM messages m JOIN chat_members cm USING (chat_id) WHERE NOT m.grp""",
    "flow": """
        SELECT msg_id, chat_id, session_id, ts_utc, ts_local, is_from_me, grp, new_block, double_text,
               sum(new_block) OVER (PARTITION BY chat_id ORDER BY ts_utc, msg_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS block_no
        FROM (SELECT *,
                     CASE WHEN lag(is_from_me) OVER w = is_from_me AND lag(session_id) OVER w = session_id
                          THEN 0 ELSE 1 END AS new_block,
                     CASE WHEN lag(is_from_me) OVER w = is_from_me
                               AND date_diff('second', lag(ts_utc) OVER w, ts_utc) >= 600
                          THEN 1 ELSE 0 END AS double_text
              FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts_utc, msg_id))""",
    "words": f"""
        SELECT * FROM (
            SELECT msg_id, chat_id, person_id, is_from_me, grp, ts_local,
                   unnest(regexp_split_to_array({FOLDED}, '[^a-z'']+')) AS word
            FROM messages WHERE text IS NOT NULL)
        WHERE length(word) >= 3 AND word NOT IN ({STOP_LIST})""",
    "sess": """
        SELECT chat_id, session_id, count(*) AS n, date_diff('second', min(ts_utc), max(ts_utc)) AS dur,
               min(ts_local) AS t0,
               arg_min(is_from_me, msg_key) AS first_mine, arg_max(is_from_me, msg_key) AS last_mine
        FROM (SELECT *, epoch_us(ts_utc)::HUGEINT * 100000000000 + msg_id AS msg_key FROM messages)
        GROUP BY ALL""",
    "texts": """
        SELECT trim(text) AS text, min(msg_id) AS text_id, count(*) AS total, count(*) FILTER (is_from_me) AS mine
        FROM messages WHERE length(trim(text)) > 0 GROUP BY 1""",
    "vecs": """
        SELECT t.text_id, e.embedding::DOUBLE[] AS embedding, e.label::BIGINT AS label
        FROM texts t JOIN embeddings e ON e.vec_id = t.text_id % (SELECT count(*) FROM embeddings)""",
    "named": "SELECT person_id, display_name FROM persons WHERE NOT starts_with(display_name, 'urn:')",
    "said": """
        SELECT m.msg_id, t.text_id, m.chat_id, m.session_id, m.ts_utc, m.is_from_me, m.grp, n.person_id AS named_id,
               strftime(m.ts_local, '%Y') AS year, strftime(m.ts_local, '%Y-%m') AS month,
               strftime(date_trunc('week', m.ts_local), '%Y-%m-%d') AS week, m.word_count, t.text
        FROM messages m JOIN texts t ON t.text = trim(m.text) LEFT JOIN named n ON n.person_id = m.person_id""",
    "scoped": """
        SELECT scope, text_id, count(*) AS n FROM (
            SELECT 'me' AS scope, text_id FROM said WHERE is_from_me
            UNION ALL SELECT 'period:' || week, text_id FROM said WHERE is_from_me
            UNION ALL SELECT 'me_with:' || named_id, text_id FROM said WHERE is_from_me AND NOT grp AND named_id IS NOT NULL
            UNION ALL SELECT 'them:' || named_id, text_id FROM said WHERE NOT is_from_me AND NOT grp AND named_id IS NOT NULL)
        GROUP BY 1, 2""",
    "centroids": """
        SELECT scope, weight, list(x / norm ORDER BY i) AS centroid
        FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY scope)) AS norm
              FROM (SELECT scope, i, sum(n) AS weight, sum(n * x) / sum(n) AS x
                    FROM (SELECT scope, n, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i
                          FROM scoped JOIN vecs USING (text_id)) GROUP BY 1, 2))
        GROUP BY 1, 2""",
    "people_vectors": """
        SELECT person_id, period, msgs, list(x / norm ORDER BY i) AS centroid
        FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY person_id, period)) AS norm
              FROM (SELECT named_id AS person_id, period, i, sum(n)::BIGINT AS msgs, sum(n * x) / sum(n) AS x
                    FROM (SELECT named_id, period, n, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i
                          FROM (SELECT named_id, text_id, 'all' AS period, count(*) AS n FROM said
                                WHERE NOT is_from_me AND named_id IS NOT NULL GROUP BY 1, 2
                                UNION ALL
                                SELECT named_id, text_id, year, count(*) FROM said
                                WHERE NOT is_from_me AND named_id IS NOT NULL GROUP BY 1, 2, 3) JOIN vecs USING (text_id))
                    WHERE named_id IN (SELECT named_id FROM said WHERE NOT is_from_me AND named_id IS NOT NULL
                                       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 40)
                    GROUP BY 1, 2, 3))
        WHERE period = 'all' OR msgs >= 30 GROUP BY 1, 2, 3""",
    "groups": """
        SELECT chat_id, coalesce(nullif(name, ''), 'Group ' || chat_id) AS name, participant_count
        FROM chats WHERE is_group""",
}


def with_prelude(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the named tables that the query needs, in dependency order."""
    tables = {**TABLES, **(extra or {})}
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", body):
                visit(tables[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({tables[name]})" for name in needed)
    own = re.match(r"\s*WITH\s+", sql)
    return f"{head},\n{sql[own.end():]}" if own else f"{head}\n{sql}"
