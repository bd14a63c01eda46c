"""Base spans of secrets and rules of URLs against scans written without patterns."""

import hashlib
import random
import string

from leadloom.llm import secrets, urltree

WORD = set(string.ascii_letters + string.digits + "+/_.=-")


def base_by_hand(text):
    """Spans of the three kinds, character by character."""
    found = []
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not lower.startswith(name, i):
                continue
            j = i + len(name)
            # an optional quote, spaces, a mark, spaces, an optional quote
            k = j + (text[j : j + 1] in ('"', "'") and text[j : j + 1] != "")
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] not in (":", "="):
                continue
            k += 1
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in ('"', "'") and text[k : k + 1]:
                k += 1
            end = k
            while end < len(text) and text[end] in WORD:
                end += 1
            if end > k:
                return end, end - k
        return None

    i = 0
    while i < len(text):
        got = assign(i)
        if got:
            if got[1] >= 12:
                found.append((i, 0, got[0]))
            i = got[0]
        else:
            i += 1
    i = 0
    while i < len(text):
        end = i + 4
        while text.startswith("AKIA", i) and end < len(text) and text[end] in string.ascii_uppercase + string.digits:
            end += 1
        if text.startswith("AKIA", i) and end > i + 4:
            if end - i >= 18:
                found.append((i, 1, end))
            i = end
        else:
            i += 1
    i = 0
    while i < len(text):
        end = i
        while end < len(text) and text[end] in "0123456789abcdef":
            end += 1
        if end - i >= 16:
            found.append((i, 2, end))
        i = max(end, i + 1)
    return sorted(found)


def odd_texts():
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ToKen", '"', "'", " ", "  ", ":", "=", "==", "\n", "\t", "é", "🙂", "AKIA", "AKIAAKIA", ".", "-x", "/"]
    value = lambda: "".join(rng.choices("abcdef0123456789", k=rng.randrange(1, 40)))
    upper = lambda: "".join(rng.choices(string.ascii_uppercase + string.digits, k=rng.randrange(1, 30)))
    made = ["".join(rng.choice([rng.choice(parts), rng.choice(parts), value(), upper()]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    return [*made, "", "token=" + "a" * 11, "token=" + "a" * 12, "AKIA" + "B" * 13, "AKIA" + "B" * 14, "f" * 15, "f" * 16, "password: " * 5 + "x" * 20, "tokentoken=abcdefghijkl", "x" * 100_000 + "secret='0123456789abcdef'"]


def test_base_spans_by_hand(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(9999, None, 1, "x")], "doc_id long, text string, spans int, kind string")
    found = {r.doc_id: r for r in secrets.digest(secrets.find(docs, secrets.fit(docs))).collect()}
    assert len(found) == len(texts) + 1 and found[9999].spans == ""
    for i, text in enumerate(texts):
        want = base_by_hand(text)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert found[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), text
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        spans = [s for s in found[i].spans.split(",") if s]
        assert [s for s in spans if not s.startswith("novel")] == [s for s in said.split(",") if s]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_the_dictionary_comes_from_whole_texts(spark):
    """Wherever a word stands in long texts, it is counted."""
    rng = random.Random(11)
    fill = lambda: " ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(4000))
    texts = [f"{fill()} quantum_flux_capacitor {fill()}" for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    assert {(r.word, r.n) for r in secrets.word_counts(docs).where("n > 5").collect()} == {("quantum_flux_capacitor", 6)}
    assert b"quantum_flux_capacitor" in secrets.fit(docs).dictionary


def rule_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in urltree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


def test_hosts_paths_and_rules_by_hand(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "example.net", "x.Example.NET", "example.com", "sub.example.com", "org", "b.ORG", "notorg", "ÄB.net", "", "net:80", "a@example.com"]
    tails = ["", "/", "/en/", "/en", "/en/x?y=/de/", "/de/", "/de/1#/fr/", "/fr/a//b", "?q=://x", "#f", "/EN/", "/fr/%20", "//"]
    urls = [f"{rng.choice(['http', 'HTTPS', '', 'x:y'])}://{h}{t}" for h in hosts for t in tails] + [None, "", "://", "a/b", "http:/net/", "x://y://net/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    found = {r.page_id: r for r in urltree.judge(pages).collect()}
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = rule_by_hand(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), url
        assert found[i].verdict == (verdict or found[i].verdict) and found[i].verdict in ("allow", "block")
