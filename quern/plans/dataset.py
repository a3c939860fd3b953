"""Training sets from ``documents`` and dialogues from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import dataset as S
from quern.plans.registry import query

SIZE, K, P = 512, 3, 0.8
CHUNKS = f"chunks AS (SELECT doc_id, k AS chunk_id, substr(text, k * {SIZE} + 1, {SIZE}) AS chunk, lang AS question FROM documents, unnest(range(0, CEIL(length(text) / {SIZE})::BIGINT)) r(k))"


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 7))::BIGINT"


def chunks(t):
    return S.fixed_chunks(t.documents, "text", SIZE, "doc_id", "lang").withColumnRenamed("lang", "question")


@query("chunk_fixed", f"WITH {CHUNKS} SELECT doc_id, chunk_id, md5(chunk) AS digest FROM chunks")
def chunk_fixed(t):
    return chunks(t).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("chunk").alias("digest"))


SEMANTIC_SQL = r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, ceil(length(text) / 2000)::BIGINT AS parts, unnest(l) AS sentence, unnest(range(len(l))) AS i FROM l),
w AS (SELECT doc_id, i, ('0x' || substr(md5(word), 1, 7))::BIGINT % 256 AS place, count(*)::DOUBLE AS c FROM (SELECT doc_id, i, unnest(regexp_split_to_array(lower(sentence), '\s+')) AS word FROM s) WHERE word <> '' GROUP BY ALL),
n AS (SELECT doc_id, i, sqrt(sum(c * c)) AS n FROM w GROUP BY ALL),
d AS (SELECT a.doc_id, a.i, sum(a.c / x.n * (b.c / y.n)) AS d FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.i = a.i + 1 AND b.place = a.place JOIN n x ON x.doc_id = a.doc_id AND x.i = a.i JOIN n y ON y.doc_id = b.doc_id AND y.i = b.i GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY (i = max_i), round(1 - coalesce(d, 0), 12) DESC, i) < parts AND i < max_i AS cut FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS max_i FROM s) s LEFT JOIN d USING (doc_id, i)),
c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_id FROM r)
SELECT doc_id, chunk_id::INT AS chunk_id, string_agg(sentence, ' ' ORDER BY i) AS chunk FROM c GROUP BY doc_id, chunk_id"""


@query("chunk_semantic", SEMANTIC_SQL)
def chunk_semantic(t):
    return S.semantic_chunks(t.documents, "text", 2000, "doc_id")


LINES = "[lang || ' 1?', '---', '2. why ' || source || '?!!', '']"


@query("gen_questions", f"SELECT doc_id, list_filter({LINES}, lambda x: regexp_matches(x, '\\p{{L}}')) AS lines, [lang || ' ', 'why ' || substr(source, 1, 4)] AS stripped FROM documents")
def gen_questions(t):
    def complete(prompts: list[str]) -> list[str]:  # a stand-in for a model
        return ["{} 1?\n---\n2. why {}?!!\n".format(*p.split("|")) for p in prompts]

    x = S.completed(t.documents.select("doc_id", F.concat_ws("|", "lang", "source").alias("prompt")), "prompt", "answer", complete)
    return x.select("doc_id", S.question_lines(F.col("answer")).alias("lines"), S.question_lines(F.col("answer"), strip=True).alias("stripped"))


PICKS = f"""{CHUNKS}, placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id) - 1 AS pos, count(*) OVER () AS n FROM chunks),
b AS (SELECT pos, n, rank, CASE WHEN rank < {K} THEN floor(rank * (n - 1) / {K})::BIGINT ELSE 0 END AS s, CASE WHEN rank < {K} THEN floor((rank + 1) * (n - 1) / {K})::BIGINT ELSE n - 1 END AS e FROM placed, range(0, {K} + 1) r(rank)),
picks AS (SELECT pos, rank, (pos + 1 + s + {hash_sql("'0'", "pos", "rank")} % (e - s)) % n AS other FROM b)"""


@query("join_distract", f"WITH {PICKS} SELECT pos, rank::INT AS rank, other FROM picks WHERE rank < {K}")
def join_distract(t):
    from quern.operators.joins import numbered

    at = numbered(chunks(t), "n", "doc_id", "chunk_id").select((F.col("n") - 1).alias("pos"))
    return S.distractors(at, K).filter(F.col("rank") < K)


ROWS = f"""{PICKS}, o AS (SELECT *, {hash_sql("'0'", "pos", "'oracle'")} < {int(P * (1 << 28))} AS oracle FROM placed),
d AS (SELECT pos, -1 AS rank, chunk FROM o WHERE oracle UNION ALL SELECT p.pos, p.rank, x.chunk FROM picks p JOIN placed x ON x.pos = p.other JOIN o ON o.pos = p.pos WHERE p.rank < {K} OR NOT o.oracle),
rows_ AS (SELECT o.pos, any_value(o.question) AS question, bool_and(o.oracle) AS oracle, count(*) AS n, any_value(o.chunk) AS chunk, string_agg('<DOCUMENT>' || d.chunk || '</DOCUMENT>' || chr(10), '' ORDER BY {hash_sql("'0'", "d.pos", "d.rank", "'place'")}, d.rank) || any_value(o.question) AS instruction FROM o JOIN d ON d.pos = o.pos GROUP BY o.pos)"""


@query("gen_row", f"WITH {ROWS} SELECT pos, question, oracle, n, md5(chunk) AS oracle_context, md5(instruction) AS instruction FROM rows_")
def gen_row(t):
    x = S.training_rows(chunks(t), K, P)
    return x.select("pos", "question", "oracle", F.size("docs").cast("long").alias("n"), F.md5("chunk").alias("oracle_context"), F.md5("instruction").alias("instruction"))


@query("gen_instruction", "SELECT doc_id, md5('<DOCUMENT>' || text || '</DOCUMENT>' || chr(10) || '<DOCUMENT>' || source || '</DOCUMENT>' || chr(10) || lang) AS digest FROM documents")
def gen_instruction(t):
    x = t.documents.select("doc_id", F.array("text", "source").alias("docs"), "lang")
    return x.select("doc_id", F.md5(S.instruction("docs", F.col("lang"))).alias("digest"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def prompt_sql(kind: str) -> str:
    return quoted(S.PROMPTS[kind]).replace("{question}", "' || lang || '").replace("{context}", "' || text || '")


@query("gen_encode", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {quoted(S.SYSTEM[k])} AS system, md5({prompt_sql(k)}) AS digest FROM documents" for k in S.PROMPTS))
def gen_encode(t):
    out = None
    for k in S.PROMPTS:
        m = t.documents.select("doc_id", F.lit(k).alias("kind"), S.messages(F.col("lang"), F.col("text"), k).alias("m"))
        x = m.select("doc_id", "kind", F.col("m")[0]["content"].alias("system"), F.md5(F.col("m")[1]["content"]).alias("digest"))
        out = x if out is None else out.unionByName(x)
    return out


ANSWERED = "a AS (SELECT doc_id, lang AS question, text AS context, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'so: <ANSWER>: x <ANSWER>: ' || source END AS cot_answer, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text || chr(10) || lang END AS instruction FROM documents)"
FULL = "cot_answer IS NOT NULL AND cot_answer <> '' AND instruction <> ''"


def answered(t):
    i = F.col("doc_id")
    cot = F.when(i % 5 == 0, None).when(i % 5 == 1, "").otherwise(F.concat(F.lit("so: <ANSWER>: x <ANSWER>: "), "source"))
    return t.documents.select("doc_id", F.col("lang").alias("question"), F.col("text").alias("context"), cot.alias("cot_answer"), F.when(i % 7 == 0, "").otherwise(F.concat_ws("\n", "text", "lang")).alias("instruction"))


@query("fmt_hf", f"WITH {ANSWERED} SELECT doc_id, question, md5(context) AS context, cot_answer, md5(instruction) AS instruction FROM a")
def fmt_hf(t):
    return S.FORMATS["hf"](answered(t)).withColumn("context", F.md5("context")).withColumn("instruction", F.md5("instruction"))


@query("fmt_completion", f"WITH {ANSWERED} SELECT md5(instruction) AS prompt, cot_answer || '<STOP>' AS completion FROM a WHERE {FULL}")
def fmt_completion(t):
    return S.FORMATS["completion"](answered(t)).withColumn("prompt", F.md5("prompt"))


@query("fmt_chat", f"WITH {ANSWERED} SELECT ['system', 'user', 'assistant'] AS roles, md5('Be brief.' || instruction || cot_answer) AS digest FROM a WHERE {FULL}")
def fmt_chat(t):
    x = S.FORMATS["chat"](answered(t), system="Be brief.")
    return x.select(F.transform("messages", lambda m: m["role"]).alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "")).alias("digest"))


@query("udf_formatter", f"WITH {ANSWERED} SELECT md5('# ' || question || chr(10) || chr(10) || coalesce(cot_answer, '(none)')) AS page FROM a")
def udf_formatter(t):
    """A format that a user adds: each row as a page with the question as its heading."""
    S.FORMATS["page"] = lambda df, empty="": df.select(F.md5(F.concat(F.lit("# "), "question", F.lit("\n\n"), F.coalesce("cot_answer", F.lit(empty)))).alias("page"))
    return S.formatted(answered(t), "page", empty="(none)")


@query("fmt_eval", f"WITH {ANSWERED} SELECT question, string_split(cot_answer, '<ANSWER>: ')[-1] AS gold_final_answer, md5(substr(instruction, 1, length(instruction) - length(question) - 1)) AS context FROM a WHERE {FULL}")
def fmt_eval(t):
    return S.FORMATS["eval"](answered(t)).withColumn("context", F.md5("context"))


@query("txt_answer", f"WITH {ANSWERED} SELECT doc_id, CASE WHEN cot_answer <> '' THEN string_split(cot_answer, '<ANSWER>: ')[-1] END AS answer FROM a")
def txt_answer(t):
    return answered(t).select("doc_id", S.final_answer(F.col("cot_answer")).alias("answer"))


@query("txt_context", "SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1), chr(10))) AS digest FROM documents")
def txt_context(t):
    return t.documents.select("doc_id", F.md5(S.without_last_line(F.col("text"))).alias("digest"))


@query("limit_qa", f"WITH {CHUNKS} SELECT doc_id, chunk_id, md5(chunk) AS digest FROM chunks ORDER BY doc_id, chunk_id LIMIT 100")
def limit_qa(t):
    x = S.first_rows(chunks(t), 100, "doc_id", "chunk_id")
    return x.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("chunk").alias("digest"))


@query("txt_fence", "SELECT event_id, CASE WHEN user_id % 3 <> 2 THEN 'run ' || event_type END AS code FROM events")
def txt_fence(t):
    u = F.col("user_id") % 3
    text = F.concat(F.lit("Do:\n```"), F.when(u == 0, "bash").when(u == 1, "sh").otherwise("sql"), F.lit("\nrun "), F.col("event_type"), F.lit("\n```\nand ```bash\nno\n```")).alias("x")
    text = F.when(u == 2, F.replace(text, F.lit("```bash"), F.lit("``"))).otherwise(text)
    return t.events.select("event_id", S.fenced(text, "bash|shell|sh").alias("code"))


@query("txt_split_calls", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN [event_type || '(a=1)', 'g()'] ELSE [] END AS calls FROM events")
def txt_split_calls(t):
    e = F.col("event_type")
    text = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("<<function>>dropped<<function>> "), e, F.lit("(a=1)\n<<function>> <<function>>g()"))).otherwise(F.concat(e, F.lit("<<function>>x()")))
    return t.events.select("event_id", S.marked_calls(text).alias("calls"))


TURNS = "c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'user' ELSE role END AS role, coalesce(text, '') AS text FROM conversations)"


@query("txt_roles", f"""WITH {TURNS}, m AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM c),
n AS (SELECT *, CASE WHEN role = 'user' AND lag(role) OVER w = 'user' THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM n),
j AS (SELECT conv_id, min(turn) AS turn, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, island, role),
e AS (SELECT conv_id, max(CASE WHEN turn = first AND role = 'system' THEN text END) AS system_prompt, max_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS last_user FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM c) GROUP BY conv_id)
SELECT j.conv_id, j.turn, j.role, md5(j.text) AS digest, md5(e.system_prompt) AS system_prompt, md5(e.last_user) AS last_user FROM j JOIN e USING (conv_id)""")
def txt_roles(t):
    c = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ends = S.dialogue_ends(c)
    return S.merged_turns(c).join(ends, "conv_id").select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.md5("system_prompt").alias("system_prompt"), F.md5("last_user").alias("last_user"))
