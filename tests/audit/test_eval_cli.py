"""The evaluation on the command line, over clients that answer from rules and a log that is there."""

import json

import pytest

from lensaudit import cli
from lensaudit.operators import calls, clients, embedding, providers, questions

URL = "https://a.net/"
BODY = "<html><head><title>Some title here</title></head><body><main><h1>Prices</h1><p>" + "The small plan costs ten euros a month. " * 40 + "</p><h2>Opening</h2><p>" + "We open at nine on weekdays. Come and see us. " * 40 + "</p><h2>Team</h2><p>" + "Ann leads the team of five people. " * 60 + "</p></main></body></html>"
FACTS = """site: https://a.net
facts:
  - {id: f1, question: "What does the small plan cost?", answer: "ten euros a month"}
  - {id: f2, question: "When do you open on weekdays?", answer: "at nine", page: /}
  - {id: f3, question: "When do you open on weekdays", answer: "at nine", page: /}
"""


@pytest.fixture
def snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = [("a", URL, 0, lens, URL, 200, {}, BODY, 1, None, None, [], None) for lens in ("browser", "GPTBot")]
    spark.createDataFrame(rows, cli.TABLES["fetches"]).write.parquet(f"{path}/fetches")
    spark.createDataFrame([("a", URL, URL)], cli.TABLES["sites"]).write.parquet(f"{path}/sites")
    (tmp_path / "facts.yaml").write_text(FACTS)
    return path, str(tmp_path / "facts.yaml")


def client():
    """Nested, as workers cannot import this module."""

    def answer(r):
        from lensaudit.operators import calls as c

        if r.as_json and "questions" in r.system:
            text = '{"questions": [{"question": "What does the small plan cost?", "reference_answer": "ten euros a month", "source_span": "The small plan costs ten euros a month."}, {"question": "Short", "reference_answer": "x"}]}'
        elif r.as_json:
            text = '{"verdict": "correct", "rationale": "same"}' if "Candidate answer: Ten euros" in r.prompt else '{"verdict": "incorrect"}'
        else:
            text = "Ten euros.\nUsed: The small plan costs ten euros a month." if "Question: What does" in r.prompt else "NOT_FOUND"
        return c.Reply(text, False, 100, 10)

    return answer


def run(spark, *args, **kw):
    out = []
    return cli.main(list(args), spark, out.append, **kw), "\n".join(out)


def test_facts_reports_and_log(spark, snapshot):
    path, listed = snapshot
    ask = ("audit", path, "--only", "STR-001", "--eval", "true", "--facts", listed, "--trials", "2", "--model", "openai/gpt-4o-mini", "--top-k", "2")
    code, text = run(spark, *ask, "--format", "json", client=client())
    e = json.loads(text)["eval"]
    assert code == 0 and (e["ground_truth"], e["confidence"], e["answerer_model"], e["embedding_model"]) == ("facts", "high", "openai/gpt-4o-mini", "lexical")
    # a page with a question of its own gets that one alone; the same question is asked once
    assert (e["question_trials"], e["mean"], e["abstention_rate"], e["questions_per_page"]) == (2, 0.0, 1.0, 1)
    assert e["failures"][0]["question"] == "When do you open on weekdays?" and e["input_tokens"] == 200 and e["cost_usd"] > 0

    def broken(r):
        raise ValueError("no network")

    code, text = run(spark, *ask, "--format", "markdown", client=broken)  # all from the log
    assert code == 0 and "## Answerability" in text and "**Mean 0.0**" in text and "2 calls were answered from the log" in text and "| When do you open on weekdays? |" in text
    assert "_calls: " in run(spark, "cache", path, "--kind", "llm")[1] and "_calls: " in run(spark, "cache", path, "--clear", "--kind", "fetch")[1]
    run(spark, "cache", path, "--clear", "--kind", "llm")
    assert "_calls: " not in run(spark, "cache", path)[1]
    assert run(spark, "audit", path, "--only", "STR-001", "--eval", "true", "--facts", "/none.yaml", client=broken)[0] == 2


def test_generated_questions_gates_and_codes(spark, snapshot):
    path, _ = snapshot
    ask = ("audit", path, "--only", "STR-001", "--eval", "true", "--trials", "1", "--judge-model", "other/judge")
    code, text = run(spark, *ask, "--format", "json", "--fail-under-eval", "101", client=client())
    doc = json.loads(text[: text.rindex("}") + 1])["eval"]
    assert code == 0 and "not judged, circular ground truth" in text and (doc["ground_truth"], doc["confidence"], doc["mean"], doc["questions_per_page"], doc["judge_model"]) == ("crawler_only", "low", 100.0, 1, "other/judge")
    assert run(spark, *ask, "--fail-under-eval", "101", "--strict-eval", client=client())[0] == 1
    assert run(spark, *ask, "--max-cost", "0.0001", client=client())[0] == 5

    def refusing(r):
        raise RuntimeError("HTTP 401: unauthorized")

    listed = snapshot[1]
    code, text = run(spark, "audit", path, "--only", "STR-001", "--eval", "true", "--trials", "1", "--model", "openai/other", "--facts", listed, client=refusing)
    assert code == 4 and "authentication error" in text
    assert run(spark, "audit", path, "--only", "STR-001", "--eval", "true", "--model", "unnamed", client=client())[0] == 2
    assert "no evaluation: no model is named" in run(spark, "audit", path, "--only", "STR-001", "--eval", "auto")[1]


def test_retrieval_by_vectors_and_its_fallback(spark, tmp_path):
    from lensaudit.operators import eval_run

    pages = spark.createDataFrame([("s", "u", "# A\n" + "alpha beta. " * 200 + "\n# B\n" + "gamma delta. " * 200 + "\n# C\n" + "words only. " * 200), ("s", "v", "bad page here")], "site_id string, url string, text string")
    asks = spark.createDataFrame([("s", "u", 1, "tell me gamma", "delta", ""), ("s", "v", 2, "a page?", "yes", "")], "site_id string, url string, q_id long, question string, reference_answer string, source_span string")
    seen = str(tmp_path / "seen")

    def vectors(texts):
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n")
        if any("bad" in t for t in texts):
            raise RuntimeError("too long")
        return [[float(t.count("gamma")), float(t.count("alpha")), 0.1] for t in texts]

    import lensaudit.operators.embedding as m

    model, m_batch = embedding.Embedder("e/x", vectors, str(tmp_path / "store"), tries=1), m.BATCH
    find = embedding.finder(model, ["site_id", "url"], 1)
    from lensaudit.operators import chunking

    chunks = chunking.prepare(pages, ["site_id", "url"])
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    got = {r.q_id: (r["by"], r.chunk_idx) for r in find(asks, chunks).collect()}
    want = {r.chunk_idx for r in chunks.where("url = 'u'").collect() if "gamma" in r.text}
    assert got[1][0] == "e/x" and got[1][1] in want and got[2] == ("lexical", 0) and m_batch == 64
    n = len(open(seen).read().split())
    texts = spark.createDataFrame([("tell me gamma",), ("tell me gamma",), (None,)], "text string")
    rows = model.vectors(texts).collect()
    assert len(rows) == 3 and len(open(seen).read().split()) == n + 1  # the question was known, the empty text not
    assert eval_run.PAGE == ["site_id", "url"]


def test_generation_drops_what_cannot_be_used(spark, tmp_path):
    pages = spark.createDataFrame([("s", "u", "The text of a page."), ("s", "v", "Cut off."), ("s", "w", " ")], "site_id string, url string, text string")
    seen = str(tmp_path / "seen")

    def client(r):
        from lensaudit.operators import calls as c

        with open(seen, "a") as f:
            f.write(f"{r.max_tokens} {'verbatim' in r.prompt} {'Page: ' in r.prompt}\n")
        if "Cut off" in r.prompt:
            return c.Reply('{"questions": [{"question": "What is it about?", "reference_answer": "It is cut off"}]}', True)
        return c.Reply('Here: {"questions": [{"question": "What is this text?", "reference_answer": "The text of a page", "source_span": "text of a  page"}, {"question": "what is this text", "reference_answer": "The text of a page"}, {"question": "What is not there?", "reference_answer": "Something else", "source_span": "not in it"}]}')

    got = questions.generate(pages, calls.Model("m", client, str(tmp_path / "log")).ask, str(tmp_path / "w"), count=5)
    assert sorted((r.url, r.question, r.source_span) for r in got.collect()) == [("u", "What is not there?", ""), ("u", "What is this text?", "text of a  page")]
    assert len(open(seen).read().strip().split("\n")) == 2


def test_endpoints_and_the_protocol():
    env = {"GROQ_API_KEY_2": "g", "NVIDIA_API_KEY": "n"}
    assert providers.endpoint("groq/x", env) == ("https://api.groq.com/openai/v1", "g")
    assert providers.endpoint("any/x", env, "https://integrate.api.nvidia.com/v1") == ("https://integrate.api.nvidia.com/v1", "n")
    assert providers.endpoint("any/x", {"K": "k"}, "http://h/v1", "K") == ("http://h/v1", "k")
    with pytest.raises(ValueError, match="base-url"):
        providers.endpoint("nobody/x", env)
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Api(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            if body.get("input"):
                said = {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
            else:
                said = {"choices": [{"message": {"content": None, "reasoning_content": " hm "}, "finish_reason": "length"}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}
            out = json.dumps(said).encode()
            self.send_response(401 if body["model"] == "no" else 200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}/v1/"
        assert clients.chat("m", base, "k")(calls.Request("p", "s", 9, True)) == calls.Reply("hm", True, 7, 3)
        path, key, body = seen[0]
        assert (path, key, body["max_tokens"], body["response_format"], [m["role"] for m in body["messages"]]) == ("/v1/chat/completions", "Bearer k", 9, {"type": "json_object"}, ["system", "user"])
        assert clients.embed("m", base)(["a", "b"]) == [[1.0], [2.0]]
        with pytest.raises(RuntimeError, match="HTTP 401"):
            clients.chat("no", base)(calls.Request("p"))
    finally:
        server.shutdown()
