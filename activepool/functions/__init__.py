"""Column builders: everything here returns a Column; all but the labels of counts stays in the JVM."""

from .numbers import (  # noqa: F401
    abbreviate_count,
    boltzmann_decay,
    decode_mean_var,
    let,
    nan_to_null,
    one_hot_unknown,
    parse_float,
    rank_score,
    safe_softplus,
    signed,
    temperature,
)
from .normal import normal_cdf, normal_pdf, prob_above  # noqa: F401
from .uniform import hash_normal, hash_uniform  # noqa: F401
