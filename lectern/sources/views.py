"""Question-bank views over the driver's tables, and the same views as DuckDB SQL.

Each view is one SELECT that both engines read, with ``{...}`` where their dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "k": "cast(get_json_object(props, '$.k') as int)",
    "day": "date_format(ts, 'yyyy-MM-dd')",
    "later": "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id)",
}
DUCK = {
    "k": "cast(json_extract_string(props, '$.k') as int)",
    "day": "strftime(ts, '%Y-%m-%d')",
    "later": "timestamp '2024-01-01 00:00:00' + to_seconds(doc_id)",
}

VIEWS = {
    "attempts": """select event_id as id, user_id, concat(user_id, '-', {day}) as session_id,
        case when event_id % 11 = 0 then '' else concat('q', {k}) end as question_id,
        case when event_id % 3 = 0 then concat('q', {k}) when event_id % 3 = 1 then '  ' end as source_question_id,
        cast(event_id % 4 as int) as selected_answer, cast({k} % 4 as int) as correct_answer,
        event_id % 4 = {k} % 4 as is_correct, value as time_taken_seconds,
        case when event_id % 13 = 0 then ' ' else concat(' ', event_type) end as topic,
        case when event_id % 7 = 0 then '' else concat('s', event_id % 3) end as subject, ts as created_at from events""",
    "questions": """select doc_id as id, source as document_id, text as question_text, lang as subject, cast(2015 + doc_id % 10 as int) as year,
        case doc_id % 4 when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' end as difficulty,
        case when n_chars < 500 then 'MCQ' when n_chars < 2000 then 'descriptive' else 'numerical' end as question_type,
        cast(doc_id % 7 + 1 as int) as start_page, cast(doc_id % 7 + 1 + doc_id % 2 as int) as end_page,
        doc_id % 100 / 100.0D as confidence, cast(doc_id % 9 as int) as owner, {later} as created_at from documents""",
    "topics": """select distinct concat(event_type, v) as id, concat(case v when 'X' then upper(event_type) else event_type end, case v when 's' then 's' else '' end) as name,
        case v when '' then 'web' when 's' then 'app' end as subject from events cross join (select '' as v union all select 's' union all select 'X') variants""",
    "question_topics": """select doc_id as question_id, concat(case doc_id % 5 when 0 then 'click' when 1 then 'view' when 2 then 'purchase' when 3 then 'signup' else 'error' end, case doc_id % 3 when 0 then '' when 1 then 's' else 'X' end) as topic_id,
        doc_id % 10 / 10.0D as confidence from documents where doc_id % 8 <> 0
        union all select doc_id, concat(case doc_id % 5 when 0 then 'click' when 1 then 'view' when 2 then 'purchase' when 3 then 'signup' else 'error' end, 'X'), doc_id % 6 / 10.0D from documents where doc_id % 3 = 0""",
    "vectors": "select vec_id as question_id, embedding, concat('m', vec_id % 2) as model, label from embeddings",
    "pages_view": """select conv_id as document_id, cast(turn as int) as page_number, role, case when role = 'user' then concat('Q', turn, '. ', text) else text end as text from conversations""",
    "jobs": """select o_orderkey as id, o_custkey as document_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'active' end as status,
        case when o_orderpriority like '1%' then 'process_document' when o_orderpriority like '2%' then 'embed' else 'classify' end as type,
        cast(o_orderkey % 130 - 10 as int) as progress, case o_orderkey % 8 when 0 then 'extracting' when 1 then 'questions' when 2 then 'images' when 3 then 'classifying' when 4 then 'embeddings' when 5 then 'uploaded' when 6 then '' else 'other' end as current_step,
        cast(o_orderkey % 5 as int) as attempts, cast(600 + o_orderkey % 100 as int) as timeout_seconds, o_orderdate as created_at, o_orderdate as updated_at from orders""",
    "calls": """select event_id as id, concat('m', event_id % 2) as model, event_type as operation, value as latency, event_type = 'error' as failed, event_id % 17 as tokens, event_id % 50 as document_id from events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of a folder."""
    sql = VIEWS[name].format(**SPARK)
    for table in ("documents", "embeddings", "events", "conversations", "orders"):
        marker = f"from {table}"
        if marker in sql:
            sql = sql.replace(marker, f"from parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that begins with the named views; ``sql`` may begin with WITH itself."""
    heads = ", ".join(f"{n} as ({VIEWS[n].format(**DUCK).replace('0D', '0::double')})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {heads}, {body[15:]}"
    return f"with {heads}, {body[5:]}" if body.lower().startswith("with ") else f"with {heads} {body}"
