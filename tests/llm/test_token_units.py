"""The encoder of token files: each unit is looked up once, and ids are the library's."""

from fuelgrid.llm import token_files


def test_new_and_known_units_are_numbered_in_one_pass_over_all_texts():
    import public_tokenizers

    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    learnt = []
    learn = e.learn
    e.learn = lambda fresh: (learnt.append(fresh), learn(fresh))
    for texts in (["", "one two two  three", "two"], [" one two", "four two \n five"], ["two one"], []):
        want = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want
    assert [list(x) for x in learnt[:1]] == [["two", "two ", "three"]] and len(learnt) == 2  # in the order met, and never again
    assert [e.seen[u] for u in learnt[0]] == [0, 1, 2]
