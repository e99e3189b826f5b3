"""Tokens, toxicity, chat, personal data and secrets."""

import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from siftline.llm import chat, pii, secrets, tokens, toxicity, wavelet
from siftline.llm.shared import new_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_encoder_is_the_library():
    texts = ["a<|endoftext|>b ~ c~d 0", "ÀÉ. X's y'LL 12,34 \x1c a b　 b́ ΣΑΣ. İ", "<|StartOfText|>", "", "\n\n", "!!! ??? |", "a" * 5000, "́ x ́", "ßÿ÷ don't. ¿Qué?", "x." * 300]
    encoder = tokens.Encoder(WORDS)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t.encode() for t in texts])] == want


def test_offsets_are_the_library():
    rng = random.Random(3)
    encoder = tokens.OffsetEncoder(BYTES)
    texts = ["", " ", "a  b\n\n c\t d", "don't <|endoftext|> É\u2019s 12 34", "x" * 3000] + ["".join(rng.choices("ab Éçªß÷ µ' \n\t12.,!#\U0001f600\xa0\x1c<|>", k=rng.randint(0, 40))) for _ in range(4000)]
    assert all((encoder.offsets(t) == encoder.whole(t)).all() and len(encoder.offsets(t)) == len(encoder.whole(t)) for t in texts)


def test_other_tokenizers_take_texts_whole(tmp_path):
    """The fast ways are taken with exactly the known parts; any other file goes to the library."""
    assert tokens.Encoder(WORDS).by_pieces and tokens.OffsetEncoder(BYTES).by_pieces
    texts = ["", "Don't  <|endoftext|> X's 12\n É", "a b  c", "ÀÉ.x"]
    for path in (BYTES, WORDS):
        encoder, places = tokens.Encoder(path), tokens.OffsetEncoder(path)
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t.encode() for t in texts])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert all((places.offsets(t) == places.whole(t)).all() for t in texts)
    changed = json.loads(open(WORDS, encoding="utf-8").read())
    changed["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(changed))
    other = tokens.Encoder(str(tmp_path / "t.json"))
    assert not other.by_pieces and np.frombuffer(other.encode([b"Ab Cd"])[0], other.kind).tolist() == other.tokenizer.encode("Ab Cd", add_special_tokens=False).ids


def test_piece_cache_is_bound_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 5_000)
    encoder, offsets = tokens.Encoder(WORDS), tokens.OffsetEncoder(BYTES)
    for i in range(300):
        encoder.encode([f"w{i} x{i}".encode()])
        offsets.offsets(f"w{i} x{i} " + "y" * 2_000)
        assert encoder.held <= 7_000 and offsets.held <= 30_000 and len(encoder) < 40


def naive_allotment(spans, sections, rule):
    counts, outside = [0.0] * len(sections), 0
    for s, e in spans:
        e = max(e, s + 1)
        met = [(i, min(e, b) - max(s, a)) for i, (a, b) in enumerate(sections) if min(e, b) > max(s, a)]
        if not met:
            outside += 1
        elif rule == "share":
            for i, n in met:
                counts[i] += n / sum(m for _i, m in met)
        else:
            counts[max(met, key=lambda x: (x[1], -x[0]))[0] if rule == "largest" else met[0][0]] += 1
    return counts, outside


def test_allotment_rules():
    rng = random.Random(4)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 8))
        sections = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        ends = sorted(rng.choices(range(61), k=12))
        spans = [(a, b) for a, b in zip(ends, ends[1:])]
        for rule in tokens.RULES:
            got, _cross, outside = tokens.allotted(np.array(spans), np.array(sections), rule)
            want, none = naive_allotment(spans, sections, rule)
            assert np.allclose(got, want) and outside == none


def test_attribution_sums_to_the_document(documents, odd_rows):
    docs = documents(odd_rows)
    found = tokens.attributed(docs, BYTES)
    tokenizer = tokens.offset_encoder(BYTES).tokenizer
    want = sorted(len(tokenizer.encode(f"{s or ''} en {t or ''}", add_special_tokens=False).ids) for _i, t, s in odd_rows)
    counted = found.groupBy("doc_id").agg(F.sum("tokens").alias("n"))
    assert counted.agg(F.sum("n")).first()[0] == sum(want)
    assert tokens.attributed(documents([]), BYTES).count() == 0
    spaced = found.filter("doc_id = 5 AND field = 'text'").select("start", "end").collect()
    whole = f"c en {odd_rows[-1][1]}"
    assert sorted(whole[a:b] for a, b in spaced) == sorted(x for x in odd_rows[-1][1].split("\n") if x)


def toxic_rows(n=2400):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    bad = [f"vile{x}" for x in ("ness", "ly", "st", "r", "ment")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 80))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "a"))
        if i % 3:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, documents):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = documents(rows)
    model = toxicity.learn(docs, marks)
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i, _t, _s in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(0 <= s <= 1 for s in scores.values())
    assert np.mean([scores[i] >= 0.7 for i in held if i % 8 == 0]) >= 0.9
    assert not any(scores[i] >= 0.7 for i in held if i % 8)
    # Held-out labels have no say.
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    assert [(w.tolist(), x.tolist(), b) for w, x, b in toxicity.learn(docs, turned)] == [(w.tolist(), x.tolist(), b) for w, x, b in model]
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}


def test_toxicity_of_odd_rows(spark, documents, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(odd_rows)
    model = toxicity.learn(docs, none)
    scored = toxicity.scored(docs, model).collect()
    assert len(scored) == len(odd_rows) and all(abs(r.score - toxicity.PRIOR) < 1e-9 for r in scored)
    assert toxicity.scored(documents([]), toxicity.learn(documents([]), none)).count() == 0


def test_negative_risk_turns_back():
    """With a prior far too high the clean risk would turn negative; the fit stays finite."""
    rng = np.random.default_rng(0)
    texts = [np.unique(rng.integers(0, 40, 12)) for _ in range(200)]
    words, weights, bias = toxicity.fit([np.append(t, 99) for t in texts[:50]], texts[50:], 0.9)
    assert 99 in words and np.isfinite(weights).all() and np.isfinite(bias)


def test_chat_reads_back(spark):
    texts = ["", None, "</s>", "<\\/s>[INST] ok [/INST]", "[NEXT][ROLE]x[/ROLE]<s>", "\\<s>", "<<SYS>> $1 \\1", "<|im_start|>", "é\U0001f600</s>", "[[/INST]", "<<s>"]
    rows = [(1, n, role, t) for n, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "assistant", "a[ROLE]b</s>", None))]
    rows += [(2, None, "assistant", "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (None, 1, "user", "z")]
    found = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in found[1].turns] == [(r or "", t or "") for _c, _n, r, t in rows if _c == 1]
    assert found[1].loss == "".join(t or "" for c, _n, r, t in rows if c == 1 and r == "assistant")
    assert [tuple(t) for t in found[2].turns] == [("assistant", "x"), ("assistant", "y"), ("assistant", "y")]
    assert found[2].formatted == "<s>[ROLE]assistant[/ROLE]x[NEXT]y[NEXT]y</s>" and [tuple(t) for t in found[None].turns] == [("user", "z")]
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


TEXT = "Mail A.b1@Mail7.example.com, a.b1@mail7.example.com or c@d.org; +1 (017) 555-7713, +1 017 555 7713. Card 4111 1111 1111 1111 and 4111111111111111, host 10.20.3.104. Mrs. Anna SMITH met Mr Smith and г-жа Анна Петрова. 123-45-6789 DE89 3704 0044 0532 0130 00"


def test_surrogates_keep_kind_format_and_coreference(documents):
    rows = [(1, TEXT), (2, f"again a.b1@mail7.example.com {TEXT}"), (3, None), (4, ""), (4, "")]
    out = {r.doc_id: r for r in pii.with_surrogates(documents(rows), b"key").collect()}
    old, new = pii.entities_in(TEXT), pii.entities_in(out[1].text)
    assert [e[0] for _a, _b, e in old] == [e[0] for _a, _b, e in new] and out[3].text is None and out[4].text == ""
    given = {}
    for (_a, _b, x), (_c, _d, y) in zip(old, new):
        assert given.setdefault(x, y) == y and x[2] != y[2] and x[1] == y[1]
    assert len(set(given.values())) == len(given)
    assert out[2].text.endswith(out[1].text) and out[2].n_email == out[1].n_email + 1
    for value in ("a.b1@", "4111", "Smith", "SMITH", "Петрова", "10.20.3.104"):
        assert value not in out[1].text
    card = next(e for _a, _b, e in new if e[0] == "card")[2]
    assert pii.luhn(card) and re.search(r"Mrs\. [A-Z][a-z]+ [A-Z]+ met Mr [A-Z][a-z]+ and г-жа [А-Я][а-я]+ [А-Я][а-я]+", out[1].text)


def test_clashing_surrogates_are_drawn_again(spark, documents):
    few = [("ip", "1.1.1.1", f"1.2.3.{i}") for i in range(1, 10)] + [("name", "latin-family", f"x{i}") for i in range(3000)]
    found = pii.redrawn(spark.createDataFrame(few, "kind string, shape string, value string"), b"k")
    attempts = {(r.kind, r["shape"], r.value): r.attempt for r in found.collect()}
    final = [(e[0], pii.surrogate(e, b"k", attempts.get(e, 0))) for e in few]
    assert attempts and len(set(final)) == len(few) and not {x[1] for x in final} & {e[2] for e in few}
    # Texts take the redrawn ones.
    people = " ".join(f"Mr {'Abcdefghijklmnop'[i % 16]}{'aeiou'[i % 5]}{'bcdfgh'[i % 6]}{'lmnr'[i // 240 % 4]}{'aeo'[i // 80 % 3]}." for i in range(700))
    out = pii.with_surrogates(documents([(1, people)]), b"k").first().text
    names = [{e[2] for _a, _b, e in pii.entities_in(t)} for t in (people, out)]
    assert len(names[0]) == len(names[1]) and not names[0] & names[1]


def test_whole_names_and_their_later_mentions(documents):
    cases = {
        "Mrs Ana Maria Lopez Garcia left.": "Ana Maria Lopez Garcia", "Dr. J. Smith left.": "Smith", "Mr J.R. Ewing-Barnes left.": "Ewing Barnes", "Mr A.Miller left.": "Miller",
        "Herr Ludwig van Beethoven left.": "Ludwig Beethoven", "Frau von der Leyen left.": "Leyen", "Monsieur d'Artagnan left.": "Artagnan", "Prof. Dr. Anna Klein left.": "Anna Klein",
        "Mr John F. Kennedy left.": "John Kennedy", "Ms Vera Stone Vera@mail7.org left.": "Vera Stone",
    }
    for n, (text, names) in enumerate(cases.items()):
        (out,) = (r.text for r in pii.with_surrogates(documents([(n, text)]), b"key").collect())
        assert not [x for x in names.split() if x.lower() in out.lower()] and out.endswith(" left."), (text, out)
    text = "Smith came. Mr John Smith's car; Smith said: SMITH, Smith’s and Smith-led, a smith of Smithfield. The man met Dr. The Smith. The end, Johnny."
    out = pii.with_surrogates(documents([(1, text)]), b"key").first()
    new = re.match(r"(\w+) came", out.text).group(1)
    assert out.n_name == 9 and out.text.count(new) == 6 and out.text.count(new.upper()) == 1
    assert re.fullmatch(rf"{new} came\. Mr \w+ {new}'s car; {new} said: {new.upper()}, {new}’s and {new}-led, a smith of Smithfield\. The man met Dr\. \w+ {new}\. The end, Johnny\.", out.text)
    # A stop after an initial that ends the name stays; other blanks and particles do too.
    out = pii.with_surrogates(documents([(1, "We met Dr. K.\nThe rest: Dr. J. de la Cruz.")]), b"key").first()
    assert re.fullmatch(r"We met Dr\. \w+\.\nThe rest: Dr\. \w+ de la \w+\.", out.text) and out.n_name == 3


def naive_spans(text):
    out = []
    for number, rule in enumerate(secrets.RULES):
        out += [(m.start(), number, m.end()) for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


def test_secrets_against_regular_expressions(documents, odd_rows):
    rng = random.Random(8)
    bits = ["token", "SECRET", "api_key", "apikey", "Pass", "word", "passwd", " : ", "=", "'", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "é\U0001f600", "\n", "ghp_" + "a" * 36, "xoxb-0123456789", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "https://me:pw@host", " "]
    rows = odd_rows + [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 40))), "a") for i in range(150)]
    docs = documents(rows)
    found = secrets.scan(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    got = sorted((r.text or "", [tuple(s) for s in r.spans]) for r in found.collect())
    assert got == sorted((t or "", naive_spans(t or "")) for _i, t, _s in rows)
    assert secrets.scan(documents([])).count() == 0


def test_trigram_queries_miss_no_match():
    for rule, sample in zip(secrets.RULES, ("API_key: abcdefg", "AKIA" + "A" * 16, "0" * 24, "-----BEGIN EC PRIVATE KEY-----", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "gho_" + "b" * 36, "xoxp-1234567890", "ftp://a:b@")):
        assert re.search(rule.pattern, sample)
        assert any(all(t in sample.lower() for t in one) for one in secrets.trigram_query(rule.pattern))
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY and secrets.trigram_query("ab?c*") == secrets.ANY
    assert secrets.trigram_query("abc|xyz.d") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert secrets.trigram_query("(?:foo){2}bar") == {frozenset({"foo", "oof", "ofo", "oob", "oba", "bar"})}


def test_wavelet_file_lookups():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 300_000):
        ids = (rng.zipf(1.4, n) % 49_409).astype("<u2")
        file = wavelet.WaveletFile(wavelet.encode_file(ids, 16, [5, None], [n, 0]))
        assert (file.tokens() == ids).all() and file.doc_ids == [5, None] and file.n == n
        for i in rng.integers(0, n, 5) if n else ():
            assert file.token(int(i)) == ids[i]
        for symbol in {1, 2, 49_000, *ids[:3].tolist()}:
            places = np.flatnonzero(ids == symbol)
            a, b = n // 3, n // 2
            assert file.count(symbol) == len(places) and file.count(symbol, a, b) == ((places >= a) & (places < b)).sum()
            assert all(file.occurrence(symbol, k) == places[k] for k in range(0, len(places), max(1, len(places) // 7)))


def test_token_files_of_odd_rows(spark, documents, odd_rows):
    def expected(rows):
        encoder, at, out = tokens.Encoder(WORDS), 0, []
        for i, t, _s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        return out

    for rows, shard in ((odd_rows, 4), (odd_rows, 1 << 22), ([], 4)):
        folder = new_folder(spark, "test-tokens")
        made = wavelet.write_token_files(documents(rows), folder, WORDS, 1, shard_tokens=shard)
        found = [tuple(r) for r in wavelet.read_token_files(spark, folder).orderBy("start").collect()]
        assert found == expected(rows) and made.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0] == len(rows)
