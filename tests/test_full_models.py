"""Registered model queries fit what the reference's runs fit, on the whole design."""
from hazardlake import estimators as Es
from hazardlake.plans import models_queries as M
from hazardlake.plans import select as Sel


def test_defaults_are_the_full_sizes():
    assert Es.BoostedCox().get("nEstimators") == 300 and Es.ForestRisk().get("nEstimators") == 300
    assert Es.Coxnet().get("nAlphas") == 100 and Es.KMeansRisk().get("nInit") == 10 and Es.BoostedTime().get("nEstimators") == 100
    assert len(M.L1_RATIOS) == 5 and len(M.KMEANS_CANDIDATES) == 7 and len(M.SWEEP) == 6


def test_grids_share_the_fits_that_differ_in_trees_only():
    boost, forest = Sel.param_grid(M.BOOST_GRID), Sel.param_grid(M.FOREST_GRID)
    assert len(boost) == 18 and len(Sel.staged_fits(boost)) == 6
    assert len(forest) == 8 and len(Sel.staged_fits(forest)) == 4
    assert sorted(i for m in Sel.staged_fits(boost).values() for i, _ in m) == list(range(18))
