"""Names that must and must not be taken for something, and texts likewise."""

import re

import pytest
from pyspark.sql import functions as F

from riskscan import patterns as P
from riskscan.functions import text as T
from riskscan.operators import capabilities as K
from riskscan.rules import tools as RT
from riskscan.sources import source_tree as S

NAMES = {
    K.is_run: (["command", "shellCommand", "code", "python_code", "script", "source_code", "sql_script"], ["country_code", "error_code", "source", "zip_code", "expression", "command_count", ""]),
    K.is_path: (["path", "outputDir", "file_name", "source-path", "directory", "destination", "files"], ["json_path", "path_count", "profile", "url_path", "name", "class_path", ""]),
    K.is_recipient: (["to", "recipients", "user_email", "chat_id", "phoneNumber", "cc"], ["chat", "id", "message_id", "subject", ""]),
    RT.asks_for_talk: (["chat_history", "allMessages", "previous_messages", "transcript", "system_prompt", "conversation", "full_conversation"], ["message", "full_name", "history", "chat_id", "user", "prompt", ""]),
    RT.remark: (["notes", "context", "metadata"], ["release_notes", "context_lines", "title", ""]),
}
SECRETS = (["apiKey", "user_password", "access-token", "client_secret", "pat", "bearer", "private_key", "token"], ["next_token", "max_tokens", "password_length", "sort_key", "pageToken", "csrf_token", "tokens", "key", "pattern", ""])


def holds(spark, column, names):
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", column.alias("hit")).collect()
    return [r["name"] for r in rows if r["hit"]]


@pytest.mark.parametrize("judge", list(NAMES), ids=lambda j: j.__name__)
def test_names(spark, judge):
    yes, no = NAMES[judge]
    assert holds(spark, judge(T.words_of(F.col("name"))), yes + no) == yes


def test_secret_names(spark):
    yes, no = SECRETS
    assert holds(spark, K.is_secret_param(F.col("name")), yes + no) == yes


def test_control_characters():
    assert all(re.search(P.CONTROL_CHARACTERS, t) for t in ["\x1b[31m", "\x1bc", "a\x07", "\x9b1m", "\x7f"])
    assert not any(re.search(P.CONTROL_CHARACTERS, t) for t in ["a\tb\r\n", "café x", "\x85", ""])


def test_environment_reads(spark):
    text = "process.env.API_KEY; process.env['DB_URL']; os.getenv(\"HOME_DIR\"); os.environ[KEY_NAME]; environ.get('LANG_X', 1); os.environ[\"PATH_A\"] ; process.env.lower"
    rows = S.env_reads(spark.createDataFrame([("s", "a.py", text), ("s", "b.py", None)], "server_id string, path string, text string")).collect()
    assert {r["name"]: r["first"]["pos"] for r in rows} == {"API_KEY": 0, "DB_URL": 1, "HOME_DIR": 2, "LANG_X": 3, "PATH_A": 4}


def test_change_words_are_not_reading_words():
    assert not K.CHANGE_WORDS & (K.READ_WORDS - {"upload"})
    assert {"get", "list", "count", "describe", "query", "check"}.isdisjoint(K.CHANGE_WORDS)


def test_a_token_before_another_thing_is_no_secret(spark):
    yes, no = ["tokenValue", "token", "user_token", "api_token_key"], ["token_city", "tokenColor", "token_bdde_city"]
    assert holds(spark, K.is_secret_param(F.col("name")), yes + no) == yes
