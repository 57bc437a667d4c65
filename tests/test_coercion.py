"""Replies of a model, well and badly formed, against a plain reading of their JSON."""

from __future__ import annotations

import json
import random
import re

from quillon.operators import coercion as C
from quillon.operators.grounding import CATEGORIES, DECISIONS, KINDS


def text(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def ids(v):
    found = [text(i) for i in v] if isinstance(v, list) else []
    return [int(i) for i in found if i and re.fullmatch("[0-9]+", i) and int(i) < 2**31]


def bad_ids(v):
    return ["citation_ids: not all are ids"] if isinstance(v, list) and len(ids(v)) < len(v) else []


def one_of(name, v, values, default, lower=True):
    s = text(v)
    s = s.lower() if s is not None and lower else s
    return (s, []) if s in values else (default, [] if s is None else [f"{name}: unknown value {text(v)}"])


def needed(name, v):
    s = text(v).strip() if v else ""
    return s, [] if s else [f"{name}: empty"]


def words(v, default=""):
    return default if v is None else text(v).strip()


def items(name, v, make, plain):
    out, errors = [], []
    for i, x in enumerate(v if isinstance(v, list) else []):
        if not isinstance(x, dict) and not (plain and isinstance(x, str)):
            errors.append(f"{name}[{i}]: no record")
            continue
        row, needs, wrong = make({plain: x} if isinstance(x, str) else x)
        errors += [f"{name}[{i}].{e}" for e in wrong]
        if row[needs]:
            out.append(row)
    return out, errors


def statement(default):
    def make(x):
        kind, e = one_of("kind", x.get("kind"), KINDS, default, False)
        said, f = needed("text", x.get("text"))
        return {"kind": kind, "text": said, "citation_ids": ids(x.get("citation_ids"))}, "text", e + f + bad_ids(x.get("citation_ids"))

    return make


def study(x):
    category, e = one_of("category", x.get("category"), CATEGORIES, "clinical")
    name, f = needed("name", x.get("name"))
    kind, g = one_of("kind", x.get("kind"), KINDS, "regulatory_interpretation", False)
    return {"category": category, "name": name, "necessity": words(x.get("necessity"), C.NECESSITY), "rationale": words(x.get("rationale")), "kind": kind, "citation_ids": ids(x.get("citation_ids"))}, "name", e + f + g + bad_ids(x.get("citation_ids"))


def conflict(x):
    said, e = needed("description", x.get("description"))
    return {"description": said, "citation_ids": ids(x.get("citation_ids")), "resolution_note": words(x.get("resolution_note"))}, "description", e + bad_ids(x.get("citation_ids"))


def decision(name, v):
    v = v if isinstance(v, dict) else {}
    status, e = one_of("status", v.get("status"), DECISIONS, "insufficient_data")
    return {"status": status, "rationale": words(v.get("rationale")), "conditions": texts(v.get("conditions")), "citation_ids": ids(v.get("citation_ids"))}, [f"{name}.{x}" for x in e + bad_ids(v.get("citation_ids"))]


def texts(v):
    return [text(x) for x in v if x] if isinstance(v, list) else []


def assessment(v):
    v = v if isinstance(v, dict) else {}
    out, errors = {}, []
    for name in C.ASSESSMENT:
        x = v.get(name)
        if name == "input_sufficient":
            out[name], e = bool(x), []
        elif name in ("clarifying_questions", "limitations"):
            out[name], e = texts(x), []
        elif name == "product_classification":
            out[name], e = words(x), []
        elif name in ("bioequivalence", "biowaiver", "additional_strengths"):
            out[name], e = decision(name, x)
        elif name == "required_studies":
            out[name], e = items(name, x, study, None)
        elif name == "conflicts":
            out[name], e = items(name, x, conflict, None)
        else:
            out[name], e = items(name, x, statement({"registration_strategy": "regulatory_interpretation", "regulatory_risks": "regulatory_risk", "potential_authority_questions": "potential_authority_question"}[name]), "text")
        errors += e
    return out, errors


def test_assessments_against_force(spark):
    rng = random.Random(3)
    scalar = lambda: rng.choice([None, True, False, 0, 7, 12, "", " ", "3", "12", "x", "да {нет}", KINDS[2], "Clinical", "REQUIRED", "possible", 10**12, -4, "4000000000"])
    loose = lambda: rng.choice([scalar(), [scalar() for _ in range(rng.randrange(4))], {}, {"text": scalar()}, []])

    def record(names):
        return {n: loose() if n in ("citation_ids", "conditions") or rng.random() < 0.1 else scalar() for n in names if rng.random() < 0.8}

    def reply():
        made = {}
        for name, shape in C.ASSESSMENT.items():
            if rng.random() < 0.15:
                continue
            if isinstance(shape, C.Items) and rng.random() < 0.9:
                made[name] = [record(shape.fields) if rng.random() < 0.8 else loose() for _ in range(rng.randrange(4))]
            else:
                made[name] = record(shape.fields) if isinstance(shape, C.Record) and rng.random() < 0.9 else loose()
        return made

    objects = [reply() for _ in range(150)]
    wrap = [lambda s: s, lambda s: f"```json\n{s}\n```", lambda s: f"вот: {s} конец"]
    data = [(k, wrap[k % 3](json.dumps(o, ensure_ascii=bool(k % 2)))) for k, o in enumerate(objects)]
    wanted = {k: assessment(o) for k, o in enumerate(objects)}
    for k, bad in enumerate([None, "", "не json", "[1, 2]", "5", '{"a": ', "null", '"{}"'], 1000):
        data.append((k, bad))
        wanted[k] = assessment(None)
    got = C.coerced(spark.createDataFrame(data, "id int, reply string"), C.ASSESSMENT)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        found = r.asDict(recursive=True)
        want, errors = wanted[r.id]
        assert found["ok"] == (r.id < 1000)
        assert {n: found[n] for n in C.ASSESSMENT} == want, data[r.id if r.id < 1000 else 0]
        assert found["errors"] == errors
    assert got.count() == len(data)


def test_repeated_and_no_replies(spark):
    df = spark.createDataFrame([(1, '{"statements": ["a"]}')] * 2 + [(None, '{"statements": [{"text": " b "}]}')], "id int, reply string")
    got = C.coerced(df, C.CHAT)
    assert sorted((str(r.id), r.statements[0].text) for r in got.collect()) == [("1", "a"), ("1", "a"), ("None", "b")]
    assert C.coerced(df.limit(0), C.ASSESSMENT).count() == 0


def test_coerced(spark):
    reply = '{"statements": ["a", {"kind": "odd", "text": "b", "citation_ids": [1, "2", "x"]}, {"text": ""}], "sufficient_basis": true, "bioequivalence": {"status": "Required"}}'
    r = C.coerced(spark.createDataFrame([(1, reply), (2, "no")], "id int, reply string"), {**C.CHAT, "bioequivalence": C.decision()}).orderBy("id").collect()
    assert r[0].ok and r[0].sufficient_basis and r[0].bioequivalence.status == "required"
    assert [(s.kind, s.text, s.citation_ids) for s in r[0].statements] == [("regulatory_interpretation", "a", []), ("regulatory_interpretation", "b", [1, 2])]
    assert not r[1].ok and r[1].statements == [] and r[1].bioequivalence.status == "insufficient_data"
