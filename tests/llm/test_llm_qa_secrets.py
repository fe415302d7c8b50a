import re

import pytest

from ferrule.llm import qa_defects, secrets

Q = "How does load_rows handle a missing index in wal.jsonl?"
LONG = "The limit is read from wal.jsonl and applied to the joined list. Entries are visited in the order of their start line."


@pytest.fixture(scope="module")
def weights():
    return qa_defects.fit_ending([LONG, LONG + " It never fails.", "Call it once.\n```python\nload(rows)\n```"] * 40)


@pytest.mark.parametrize(
    ("answer", "defect"),
    [(None, "empty"), ("", "empty"), ("  \n", "empty"), ("n/a.", "empty"), ("```\n```", "empty"), ("\u200b", "empty"), ("...", "empty"), (Q, "copy"), (Q.upper(), "copy"), ("Q: " + Q, "copy"), ("**" + Q + "**", "copy"), (Q + " " + Q, "copy"), (Q + " " + LONG, None), ("I'm sorry, but I can't help with that.", "refusal"), ("Good question! I'm afraid I can't give you an answer here.", "refusal"), ("Je suis désolé, mais je ne peux pas répondre à cette question.", "refusal"), (LONG + " I cannot be retried by the caller, says the comment.", None), ("Zuerst prüft die Funktion den Lader und gibt nichts zurück, wenn kein Eintrag für den Index existiert.", "language"), ("Функция сначала проверяет индекс и возвращает пустое значение.", "language"), (LONG + ' The log then says "accès refusé".', None), (LONG + " The client cannot retry here bec", "truncated"), (LONG + "\n```python\nif x is None:\n    return f(", "truncated"), ("Never.", None), ("In `load_rows`.", None), (LONG + " The entry point is `load()`", None), (LONG, None)],
)
def test_defects(weights, answer, defect):
    assert qa_defects.defect(Q, answer, weights) == defect


def test_pairs(spark):
    rows = [(1, Q, None, "x"), (1, Q, None, "x"), (2, None, LONG, "x"), (3, Q, LONG, "x"), (None, Q, None, "x"), (4, Q, "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "qa_id long, question string, ground_truth_answer string, defect string")
    got = {r["qa_id"]: r["defect"] for r in qa_defects.defective_pairs(df).collect()}
    assert got[1] == "empty" and 2 not in got and 3 not in got and None not in got
    assert qa_defects.defective_pairs(df.limit(0)).count() == 0


S = "k9TqZ0vB3nXw7LrP2sYdHf"
PEM = "-----BEGIN RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("line", "secret"),
    [(f'api_key = "{S}"', S), (f"const authToken = '{S}';", S), (f'var SIGNING_KEY_0 = "{S}";', S), ("password: 'River!42stone'", "River!42stone"), (f"export API_TOKEN={S}", S), (f'dsn = "postgres://app:{S}@db.internal/x"', S), (f'headers = {{"Authorization": "Bearer {S}"}}', S), (f"# old client_secret, still valid: {S}", S), (f"passwd = os.environ.get('PASSWD', '{S}')", S), (f"cmd = 'deploy --user ann --secret {S}'", S), ('api_key = "changeme"', None), ('password = "<your-password>"', None), ('checksum = "3932f5e18e2f2be5cc3fa676304650d59576ecd4"', None), ('request_id = "9c7c7538-a52f-8f8a-93dd-8afdaa4e0741"', None), ('token = "primary-500"', None), ('secret = os.environ["SECRET"]', None), ("# passwd is read from the vault", None), ("def merge_token_stream(items, limit=12):", None), ("-----BEGIN PUBLIC KEY-----", None), ('hint = "password must have 12 characters"', None)],
)
def test_credentials(line, secret):
    found, masked = secrets.scan(line, [0], secrets.trained(), {})
    assert bool(found) == bool(secret)
    if secret:
        assert re.search(secrets.GATE, line) and re.search(secrets.GATE_VALUE, line)
        assert masked == line.replace(secret, "*" * len(secret))


def test_private_keys_span_lines():
    text = f"a = 1\nkey: |\n  {PEM}\n  AbCdEf0123456789+/AbCdEf0123456789\n  -----END RSA PRIVATE KEY-----\nb = 2"
    found, masked = secrets.scan(text, [2, 4], secrets.trained(), {})
    assert found == [3] and masked.split("\n")[:2] == ["a = 1", "key: |"] and masked.endswith("\nb = 2") and "AbCdEf" not in masked and len(masked) == len(text)


def test_find_credentials(spark):
    rows = [(1, f'x = 1\r\napi_key = "{S}"\r\n', 0), (1, f'x = 1\r\napi_key = "{S}"\r\n', 0), (2, None, 0), (3, "", 0), (None, f'api_key = "{S}"', 0), (4, "x = 1\n" * 30_000 + f"password = '{S}'", 0)]
    got = {r["record_key"]: r for r in secrets.find_credentials(spark.createDataFrame(rows, "id long, t string, lines int"), "id", "t").collect()}
    assert set(got) == {"1", "4"} and got["1"]["lines"] == [2] and got["4"]["lines"] == [30_001]
    assert got["1"]["masked"] == 'x = 1\r\napi_key = "' + "*" * len(S) + '"\r\n'
    assert secrets.find_credentials(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_every_line_is_read(spark):
    lines = [f'client = Client("sk-{S}{S}")', f'_x = "hf_{S}{S}"', f'creds = "{S}"', f"signing_key_v2 = '{S}'", f'private_key_b64 = "{S}"', f'x = "npm_{S}{S}"', f'x = "ya29.{S}"', f'x = "dop_v1_{S}"', f'dsn = "{S}"']
    rows = [(str(i), x) for i, x in enumerate(lines)] + [("after", f'api_key = (\n    "{S}"\n)'), ("yaml", f"a: 1\npassword:\n  {S}\n")]
    rows += [("digest", 'checksum = (\n    "3932f5e18e2f2be5cc3fa676304650d59576ecd4"\n)'), ("tag", 'def f(x) -> dict:\n    """RIVER-5012"""\n'), ("blob", S * 2 + "AbCdEf0123456789+/A/\n" + "Zm9vYmFy/+9=\n")]
    got = {r["record_key"]: r for r in secrets.find_credentials(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}
    assert set(got) == {str(i) for i in range(len(lines))} | {"after", "yaml"}
    assert got["after"]["lines"] == [2] and got["yaml"]["lines"] == [3] and all(S not in r["masked"] for r in got.values())


def test_token_shapes_end_on_long_digit_runs():
    assert secrets.kind("a" + "1" * 60 + "Z!") and secrets.kind("a1-2_3.4567890") == "wordnum" and secrets.kind("a1--2") != "wordnum"


def test_held_out_lines():
    lines = [x for x in secrets.write_lines(600, seed=77) if x[0]]
    wrong = sum(secrets.trained().label(secrets.features(t)) != y for t, y in lines)
    assert wrong / len(lines) < 0.03


def test_tokens_are_labelled_as_by_their_features():
    field = secrets.trained()
    for tokens, _ in secrets.write_lines(300, seed=5):
        if tokens:
            assert field.label_tokens(tokens) == field.label(secrets.features(tokens))


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    f = secrets.Field(r.normal(size=(50, 2)), r.normal(size=(2, 2)))
    feats = [[int(x) for x in r.integers(0, 50, 3)] for _ in range(6)]
    score = lambda p: sum(f.emit[feats[i]].sum(0)[y] for i, y in enumerate(p)) + sum(f.move[a, b] for a, b in itertools.pairwise(p))
    assert f.label(feats) == list(max(itertools.product((0, 1), repeat=6), key=score))
