import numpy as np

from codicil.llm import hmm


def test_the_model_starts_from_no_sample_of_the_texts():
    settings = hmm.Settings(states=3, own_classes=8, ending_classes=4)
    prior = np.full(settings.classes, 1 / settings.classes)
    model = hmm.starting_point(prior, settings)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and not np.allclose(model.emit[:, 0], model.emit[:, 1])
    assert not hasattr(settings, "start_tokens")


def test_single_precision_gives_the_counts_of_double():
    rng = np.random.default_rng(2)
    model = hmm.starting_point(rng.dirichlet(np.full(400, 0.05)) * 0.999 + 0.001 / 400, hmm.Settings(states=4))
    lengths = np.array([1, 30, 2048, 9000, 7])
    classes = rng.integers(0, 400, lengths.sum()).astype(np.int32)
    exact, single = hmm.Sums(4, 400), hmm.Sums(4, 400)
    hmm.likelihoods(model, classes, lengths, exact)
    hmm.likelihoods(model.cast(np.float32), classes, lengths, single)
    for a, b in ((exact.start, single.start), (exact.move, single.move), (exact.emit, single.emit)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)
    assert np.isclose(single.emit.sum(), lengths.sum(), rtol=1e-5)
