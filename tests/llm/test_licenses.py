"""License scans against plain Python and against SQL, on texts that are as odd as they may be."""

import random
import re

import duckdb
import pyarrow as pa
import pytest

from quillmine.llm import licenses

WORD = re.compile(licenses.WORD)
MIT = dict(licenses.TEMPLATES)["mit"].replace("*", " ")
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of Somebody
nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""


def prose(rng, n):
    v = ["the", "software", "license", "rights", "copy", "granted", "permission", "to", "été", "use", "data", "mit", "cc", "by", "gnu", "notice"]
    v += [f"w{i}" for i in range(60)]
    return " ".join(rng.choice(v) for _ in range(n))


def rows():
    rng = random.Random(9)
    out = [(i, prose(rng, rng.choice([3, 30, 400]))) for i in range(40)]
    out += [(100, f"{prose(rng, 50)}\n/* {MIT} */ {prose(rng, 60)}"), (101, MIT.upper()), (102, MIT.replace("substantial", "large")), (103, f"# {prose(rng, 900)} {BSD3}")]
    out += [(104, "Released under the MIT License."), (105, "GNU general\tpublic--LICENSE, version 3. gnu general public license"), (106, "Licensed under CC BY-NC 4.0."), (107, "cc by cc by mit licenses mit license")]
    out += [(108, "Licensed under the Apache License, Version 2.0."), (109, "Released into the public domain: free and unencumbered software"), (110, "Mit Licenſe GNU GENERAL PUBLIC LICENSEé")]
    out += [(111, None), (112, ""), (113, " .,- "), (114, "Known marK cc by"), (115, "the MIT license " * 3000 + MIT), (116, " ".join(MIT.split()[::-1]))]
    out += [(117, ("permission is hereby granted free of charge " * 400) + MIT), (118, MIT + " " + BSD3), (101, MIT.upper()), (None, "mit license"), (None, None), (-5, "CC BY-SA\0apache license")]
    words = MIT.split()
    words[20:20] = ["to", "whom", "it", "may", "concern"]  # within the drift
    out += [(119, " ".join(words)), (120, " ".join(words[:20] + ["x"] * 40 + words[25:]))]
    return out


def brute(rows):
    known = licenses.templates()
    split = [(i, WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))) for i, t in rows]
    vocab = {w for t in known for w in t.words}
    df = {}
    for _, ws in split:
        for w in set(ws) & vocab:
            df[w] = df.get(w, 0) + 1
    rare = lambda ws: sorted(ws, key=lambda w: (df.get(w, 0), w))
    out = []
    for i, ws in split:
        base = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(ws)) if ws[p : p + len(phrase.split())] == phrase.split()]
        places = [p for p, _ in base]
        labels, score = {label for _, label in base}, 1.0 if base else 0.0
        window = lambda at, n, ws=ws: ws[max(at - licenses.DRIFT, 0) :][: n + 2 * licenses.DRIFT]
        for t in known:
            if not set(t.must()) <= set(ws):
                continue
            roots = rare(set(t.words) & set(ws))[: licenses.ROOTS]
            first = rare(t.must())[0]
            for begin in {p - q for p, w in enumerate(ws) if w == first for q in t.places(first)}:
                near = sum(any(w in window(begin + q, 1) for q in t.places(w)) for w in roots)
                if 2 * near >= len(roots) and all(f" {n} " in f" {' '.join(window(begin + q, len(n.split())))} " for n, q in t.needs):
                    labels.add(t.label)
                    score = max(score, len(set(t.words) & set(window(begin, len(t.words)))) / len(set(t.words)))
        ends = (min(places), max(places)) if places else (None, None)
        out.append((i, len(ws), len(base), *ends, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


def table(spark, rows):
    schema = "doc_id long, text string, word string, label string, labels string, score string, n_words string, qm_w int"
    return spark.createDataFrame([(i, t, "w", "l", "m", "s", "n", 1) for i, t in rows], schema).repartition(3)


def test_against_plain_python(spark):
    got = licenses.licenses(table(spark, rows()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows()), key=repr)


def test_what_is_found(spark):
    by = {r["doc_id"]: r for r in licenses.licenses(table(spark, rows())).collect()}
    assert by[100]["labels"] == "mit" and by[100]["base_labels"] == "" and by[100]["score"] > 0.95 and by[100]["first_word"] is None
    assert by[101]["labels"] == "mit" and by[102]["labels"] == "" and by[116]["labels"] == "" and by[120]["labels"] == "" and by[119]["labels"] == "mit"
    assert {"bsd", "bsd-3-clause"} <= set(by[103]["labels"].split(",")) and by[118]["labels"] == "bsd,bsd-3-clause,mit"
    assert (by[105]["n_base"], by[105]["first_word"], by[105]["last_word"], by[105]["labels"]) == (2, 0, 6, "gpl,gpl-3.0")
    assert (by[106]["base_labels"], by[106]["labels"]) == ("cc-by", "cc-by,cc-by-nc")
    assert (by[107]["n_base"], by[107]["first_word"], by[107]["last_word"], by[107]["base_labels"]) == (3, 0, 6, "cc-by,mit")
    assert by[108]["labels"] == "apache,apache-2.0" and by[110]["n_base"] == 0 and by[115]["n_base"] == 3000
    assert by[117]["labels"] == "mit" and by[114]["n_words"] == 3
    assert all(by[i]["labels"] == "" for i in range(40) if by[i]["n_base"] == 0)


def test_empty_table(spark):
    assert licenses.licenses(table(spark, [])).collect() == []


def test_sql(spark):
    some = [(i, t) for i, t in rows()]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in some], pa.int64()), "text": [t for _, t in some]}))
    want = con.execute(licenses.oracle())
    names = [d[0] for d in want.description]
    got = licenses.licenses(table(spark, some)).select(*names).collect()
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, want.fetchall()), key=repr)


def test_no_python_and_one_exchange(spark):
    df = licenses.licenses(table(spark, rows()).coalesce(1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


@pytest.mark.parametrize("t", licenses.templates(), ids=lambda t: t.label)
def test_templates_find_themselves(t):
    assert t.needs and all(t.words[q : q + len(n.split())] == n.split() for n, q in t.needs)
