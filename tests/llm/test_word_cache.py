"""The packing operator's words: frequent ones stay known when many rare ones come between."""

from public_tokenizers import path

from textfacts.llm import packing


def test_frequent_words_are_learnt_once(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 40)
    encode, learnt = packing.Encoder(path("word_bpe_49k.json")), []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda words, size: (learnt.extend(words), learn(words, size)))
    texts = ["common " + " ".join(f"rare{chr(97 + n)}{chr(97 + i)}" for i in range(6)) + " 1,5" for n in range(20)]
    got = [encode([t])[0] for t in texts]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(b).cast("I")) for b in got] == want
    assert learnt.count(b"common") == learnt.count(b"1,5") == 1
    assert len(encode.known) + len(encode.older) <= 40
