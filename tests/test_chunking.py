"""E-22 chunker vs a plain-Python restatement of the documented algorithm."""

import random
import re

from tidewatch.operators import text as TX


def brute_chunks(text, max_tokens=512):
    lines = text.split("\n")
    sections, name, cur = [], "Introduction", []
    for line in lines:
        m = re.match(TX.RE_SECTION_HEADER, line)
        if m:
            if cur:
                sections.append((name, "\n".join(cur)))
            name, cur = m.group(2).strip(), []
        else:
            cur.append(line)
    if cur:
        sections.append((name, "\n".join(cur)))
    out = []
    for sec, content in sections:
        if len(content) // 4 <= max_tokens:
            out.append((sec, content.strip()))
            continue
        chunk, length = [], 0
        for para in content.split("\n\n"):
            pt = len(para) // 4
            if length + pt > max_tokens and chunk:
                out.append((sec, "\n\n".join(chunk).strip()))
                chunk = [chunk[-1]]
                length = len(chunk[0]) // 4
            chunk.append(para)
            length += pt
        if chunk:
            out.append((sec, "\n\n".join(chunk).strip()))
    return out


def _doc(rng):
    parts = []
    if rng.random() < 0.5:
        parts.append("preface line about 10.1.2.3 and 8.8.8.8")
    for s in range(rng.randint(1, 4)):
        parts.append(f"{'#' * rng.randint(1, 3)} Section {s}")
        paras = [" ".join(rng.choice(["alpha", "T1059.001", "evil.org", "x" * 40, "CVE-2024-12345"])
                          for _ in range(rng.randint(5, 300))) for _ in range(rng.randint(1, 8))]
        parts.append("\n\n".join(paras))
    return "\n".join(parts)


def test_chunking_matches_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, _doc(rng)) for i in range(40)] + [(99, "# Only header"), (100, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {}
    for r in TX.chunk_documents(df).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.section, r.content))
    for doc_id, text in docs:
        want = brute_chunks(text)
        have = [(s, c) for _, s, c in sorted(got.get(doc_id, []))]
        assert have == want, doc_id


def test_chunk_iocs_filters(spark):
    df = spark.createDataFrame([("see 10.0.0.1 8.8.8.8 example.com evil.org T1059 CVE-2024-0001",)], "t string")
    iocs = df.select(TX.chunk_iocs("t").alias("i")).collect()[0].i
    assert "ipv4:8.8.8.8" in iocs and "ipv4:10.0.0.1" not in iocs
    assert "domain:evil.org" in iocs and "domain:example.com" not in iocs
    assert "cve:CVE-2024-0001" in iocs and "mitre_technique:T1059" in iocs
