"""Rounding used by registered queries and their oracle SQL alike.

Values are rounded to significant digits with exact powers of ten only, so
both engines produce the same double. Sums of cent amounts are exact decimals
and keep 10 digits; statistics whose last digits depend on the summation
algorithm (SD, variance, correlation, model outputs) keep 6.
"""

from __future__ import annotations

import re

# Exact decimal ties (a mean of cents over 8 rows) sit on a rounding edge and
# the engines differ there by one ulp; scaling magnitudes up by a relative
# 1e-12 before rounding moves every such tie clearly past the edge.
BIAS = 1e-12
SIG_DEFAULT = 10
SIG_NOISY = 6
NOISY = re.compile(
    r"(?i)(std|^sd$|_sd$|^sd_|regularity|var|corr|^se$|_se$|stat|estimate|coef|"
    r"^t$|p_value|pvalue|r2|rsq|aic|bic|loglik|deviance|sigma|auc|loss|rmse|mae|mse|"
    r"alpha|loading|weight|score_|density|surv|ci_|conf_|lower|upper|chisq|vif|oe_term|^[xy]_mean$|effect|roi|"
    r"nrmse|rssd|response|spend_opt|theta|slope|intercept|kernel|silhouette|importance|tpr|fpr|"
    r"fitted|resid|prediction|^ns|_ns\d|adstock|saturated|season|median|spend_opt|total_resp|^pc\d+$)")


def digits_for(name: str) -> int:
    return SIG_NOISY if NOISY.search(name) else SIG_DEFAULT
