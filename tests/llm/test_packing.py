"""What the packing step holds at a time."""

import public_tokenizers

from terrapace.llm.packing import WordTokenizer


def test_new_words_are_tokenised_a_few_thousand_at_a_time(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{'abcdefghij'[i % 10]}{i}x," for i in range(k, k + 7000)).encode() for k in (0, 3500)]
    tokenizer, seen, add = WordTokenizer(path), [], WordTokenizer.add
    monkeypatch.setattr(WordTokenizer, "add", lambda self, words: (seen.append(len(words)), add(self, words))[1])
    got = tokenizer.encode(texts)
    assert sum(seen) == 10_500 and max(seen) <= 4096
    plain = tokenizer.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in got] == [e.ids for e in plain]
