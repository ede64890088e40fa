"""Shared fragments of oracle SQL."""

from datasheaf.functions.text import PUNCTUATION, SPACES, STRIP, WORD

WORD_SQL = WORD
STRIP_SQL = STRIP
PUNCT_SQL = PUNCTUATION.replace("'", "''")
SPACES_SQL = SPACES


def words(col: str) -> str:
    return f"regexp_extract_all({col}, '{WORD}')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '{STRIP}', '', 'g')"


def draw_int(seed: str, *ids: str) -> str:
    parts = "||':'||".join([f"'{seed}'", *[f"({i})::VARCHAR" for i in ids]])
    return f"(('0x'||substr(md5({parts}),1,8))::BIGINT)"


def draw(seed: str, *ids: str) -> str:
    return f"({draw_int(seed, *ids)} / 4294967296.0::DOUBLE)"


def digest(seed: str, *ids: str) -> str:
    return "md5(" + "||':'||".join([f"'{seed}'", *[f"({i})::VARCHAR" for i in ids]]) + ")"


# Words of every document line with the end marker, numbered over the whole corpus.
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS value, " \
        "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"
CORPUS = f"""(SELECT doc_id, line, row_number() OVER (ORDER BY doc_id, line, i) - 1 AS pos, token FROM (
    SELECT doc_id, line, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, line, list_append({words('value')}, '<eos>') AS ws FROM {LINES})))"""
