"""Values that must equal the original jobs' for the same results.

Fixed values, stated as they are used:
"""

# Requested seasons (command-line default) and scaling.
REQUEST_SEASONS = (2014, 2015, 2016, 2017)
EPS_TRAIN = 1e-14            # min-max denominator offset, training rows
EPS_TEST = 1.0               # min-max denominator offset, test rows
FALLBACK_PROB = 0.5          # team without any prediction
HOLDOUT_TEST_PCT = 30        # hold-out share of the leaf-stack check

# Logistic regression with cross-validation.
LR_C = 1.0
LR_CV_FOLDS = 20
LR_CV_NUM_C = 10             # C on a log grid from 1e-4 to 1e4
LR_CV_C_RANGE = (1e-4, 1e4)

# Boosted trees.
GBT_TREES = 40
GBT_DEPTH = 3
GBT_FEATURE_SHARE = 0.5      # features a node draws
GBT_RATE = 0.1
GBT_GRID_1 = {"trees": [500, 1000], "feature_share": [0.001, 0.005], "depth": [2, 3, 5]}
GBT_GRID_2 = {"trees": [1000], "feature_share": [0.0005, 0.0003, 0.001], "depth": [2, 3, 5]}
GBT_GRID_FOLDS = 10
GBT_GRID_SEED = 3
BOOST_SUBSAMPLE = {"rate": 0.03, "trees": 900, "bag": 0.8, "column_share": 0.8, "l2": 1.0, "seed": 3}
BOOST_SUBSAMPLE_GRID = {"depth": [3, 5, 7, 9], "min_child_weight": [1, 3, 5]}
BOOST_SUBSAMPLE_FOLDS = 20

LEAF_LR_FOLDS = 10           # search of the LR on leaves and features

# Support vector machines.
SVC_CS = (1.0, 10.0, 100.0)
SVC_GAMMAS = (1e-3, 1e-4)
SVC_FOLDS = 15
SVC_FREQUENCIES = 64         # of the kernel's random Fourier features
SVC_SEED = 17

# Latent-factor model.
FACTORS = 50
FACTOR_L2 = 1e-4
FACTOR_STEP = 0.001
FACTOR_EPOCHS = 100
FACTOR_BATCH = 128
FACTOR_PATIENCE = 5
