"""Fixed values of the demand and capacity data model."""

#: Windows of the hourly panel, in hours.
LAGS = (1, 2, 3, 6, 12, 24, 48, 72)
MEAN_WINDOWS = (3, 6, 12, 24)
STD_WINDOWS = (6, 24)
WARMUP_HOURS = 72
VALIDATION_HOURS = 48
TEST_HOURS = 72

#: Simulation and capacity policy.
HORIZON = 24
SIMULATIONS = 10_000
SEED = 42
LEAST_VECTORS = 100
HEADROOMS = (0, 5, 10, 15, 20, 25, 30, 35, 40, 50)
PERCENTILES = (50, 80, 90, 95, 99)
SHORTAGE_TARGET = 0.05

TEMPORAL = ("hour_of_day", "hour_sin", "hour_cos", "trace_day_index")
FEATURES = (
    *TEMPORAL,
    *(f"lag_{k}" for k in LAGS),
    *(f"rolling_mean_{n}" for n in MEAN_WINDOWS),
    *(f"rolling_std_{n}" for n in STD_WINDOWS),
    "rolling_max_24",
    "rolling_min_24",
    "historical_load_ratio",
    "lag24_trigger_share",
)

FUNCTION_KEY = ("trace_day", "HashOwner", "HashApp", "HashFunction")
TOTAL = "ALL_TRIGGERS"
SEASONAL, HOURLY_MEAN, GBDT, SARIMAX = "Seasonal Naive", "Historical Hour-of-Day Mean", "LightGBM", "SARIMAX"
#: Trigger vocabulary in declared order.
TRIGGERS = ("http", "timer", "event", "queue", "storage", "orchestration", "others")
