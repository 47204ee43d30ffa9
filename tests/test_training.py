import numpy as np
import pytest

from tesserae.operators import model, training
from tesserae.sources import reports

SIZES = {"in_channels": 3, "latent": 4, "base": 3}


def weights(seed=0):
    return model.random_weights(seed, **SIZES)


@pytest.mark.parametrize("step,back", [(model.conv, training.conv_gradients), (model.conv_transposed, training.transposed_gradients)])
def test_gradients_of_layers_by_differences(step, back):
    rng = np.random.default_rng(0)
    x, bias = rng.normal(size=(2, 3, 4, 6)), rng.normal(size=5)
    weight = rng.normal(size=(5, 3, 4, 4) if step is model.conv else (3, 5, 4, 4))
    out = rng.normal(size=step(x, weight, bias).shape)
    args = [x, weight, bias]
    for i, grad in enumerate(back(x, weight, out)):
        assert grad.shape == args[i].shape
        for at in rng.integers(0, args[i].size, 12):
            moved = [a.copy() for a in args]
            moved[i].flat[at] += 1e-6
            assert abs(((step(*moved) - step(*args)) * out).sum() / 1e-6 - grad.flat[at]) < 1e-4


def test_gradient_of_the_model_by_differences():
    rng = np.random.default_rng(1)
    w, x = weights(), rng.random((3, 3, 16, 32))
    losses, grads = training.squared_error(x, w)
    want = ((model.decode(model.encode(x, w), w) - x) ** 2).sum((1, 2, 3))
    assert np.allclose(losses, want) and sorted(grads) == sorted(w)
    for name in w:
        for at in rng.integers(0, w[name].size, 4):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name].flat[at] += 1e-5
            down[name].flat[at] -= 1e-5
            slope = (training.squared_error(x, up, False)[0].sum() - training.squared_error(x, down, False)[0].sum()) / 2e-5
            assert abs(slope - grads[name].flat[at]) < 1e-4 * max(1, abs(slope)), name


def test_flat_and_shaped():
    w = weights()
    back = training.shaped(training.flat(w), w)
    assert all((back[k] == w[k]).all() for k in w) and training.flat(w).size == model.parameter_count(**SIZES)


def test_adam_by_its_formulas():
    adam, v = training.Adam(0.1), np.array([1.0, -2.0])
    m = q = np.zeros(2)
    want = v
    for t in range(1, 6):
        g = np.array([t, -0.5])
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        want = want - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
        v = adam.step(v, g)
    assert np.allclose(v, want)


def pictures(n, seed=0):
    """Frames of two shades, a vertical edge between them."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 16, 16, 3), np.uint8)
    for f in x:
        f[:] = rng.integers(0, 256, 3)
        f[:, rng.integers(2, 14) :] = rng.integers(0, 256, 3)
    return x


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, f.tobytes(), "own") for i, f in enumerate(x)], "frame_id long, pixels binary, task string")


def test_sums_over_tasks_are_those_of_one(spark, monkeypatch):
    monkeypatch.setattr(training, "PIECE", 100)
    monkeypatch.setattr(training, "GROUP_VALUES", 2000)
    x = pictures(23)
    own = x.transpose(0, 3, 1, 2) / 255.0
    losses, grads = training.squared_error(own, weights())
    frames = table(spark, x).repartition(5).selectExpr("pixels as x")
    loss, gradient = training.batch_gradient(frames, weights(), (3, 16, 16))
    assert abs(loss - losses.sum() / own.size) < 1e-12 and np.allclose(gradient, training.flat(grads) / own.size, atol=1e-12)
    planes = spark.createDataFrame([(f.ravel().tolist(),) for f in own], "x array<double>")
    assert abs(training.batch_gradient(planes, weights(), (3, 16, 16))[0] - loss) < 1e-9
    with pytest.raises(ValueError):
        training.batch_gradient(frames.limit(0), weights(), (3, 16, 16))
    found = training.validate(table(spark, x).selectExpr("frame_id div 10 as batch_id", "pixels as x"), weights(), (3, 16, 16))
    each = [losses[a : a + 10].sum() / own[a : a + 10].size for a in (0, 10, 20)]
    assert abs(found["loss"] - np.mean(each)) < 1e-12 and abs(found["psnr"] - np.mean([-10 * np.log10(e) for e in each])) < 1e-9


def test_losses_fall_and_a_resumed_run_is_the_unbroken_one(spark, tmp_path):
    frames, held = table(spark, pictures(24)), table(spark, pictures(8, 1), 100)
    settings = {"shape": (3, 16, 16), "batch_size": 8, "seed": 7}
    whole = training.train(frames, held, training.Run(weights(), training.Adam(0.01)), epochs=4, **settings)
    assert [r["epoch"] for r in whole.history] == [1, 2, 3, 4] and whole.history[-1]["train_loss"] < whole.history[0]["train_loss"] and whole.adam.steps == 12
    told = []

    def saved(run, better):
        told.append((run.epoch, better))
        reports.save_run(tmp_path / "latest.npz", run, {"sizes": SIZES})

    training.train(frames, held, training.Run(weights(), training.Adam(0.01)), epochs=2, saved=saved, **settings)
    again, config = reports.load_run(tmp_path / "latest.npz")
    assert config == {"sizes": SIZES} and again.epoch == 2 and [e for e, _ in told] == [1, 2] and told[0][1]
    again = training.train(frames, held, again, epochs=2, **settings)
    assert all(np.allclose(again.weights[k], whole.weights[k], atol=1e-10) for k in whole.weights)
    assert [round(r["val_loss"], 10) for r in again.history] == [round(r["val_loss"], 10) for r in whole.history]
    with pytest.raises(ValueError, match="don't fit the model"):
        reports.load_run(tmp_path / "latest.npz", latent=8)


def test_short_runs_and_refusals(spark):
    frames = table(spark, pictures(10))
    settings = {"shape": (3, 16, 16), "batch_size": 3, "seed": 1, "epochs": 1}
    seen = []

    def augment(df, epoch):
        seen.append(epoch)
        return df

    run = training.train(frames, frames, training.Run(weights()), max_batches=2, augment=augment, **settings)
    assert run.adam.steps == 2 and seen == [1]
    for bad in ({"epochs": 0}, {"batch_size": 0}, {"shape": (3, 16, 20)}, {"shape": (1, 16, 16)}):
        with pytest.raises(ValueError):
            training.train(frames, frames, training.Run(weights()), **(settings | bad))
    with pytest.raises(ValueError, match="without frames"):
        training.train(frames.limit(0), frames, training.Run(weights()), **settings)
