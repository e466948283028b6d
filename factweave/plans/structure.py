"""Structural checks: seven yes-or-no rules over types, impls and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import sets
from factweave.plans.code_rules import module_of
from factweave.plans.config import Config
from factweave.plans.findings import finding, union


def checks(functions: DataFrame, types: DataFrame, impls: DataFrame, config: Config = Config()) -> DataFrame:
    """BTC, SLM, NMS count for responsibility; OI, SIT, DEH, IET for coupling."""
    c = config.structural
    f = functions.where("has_body and not in_test")
    own = f.where("owner = 'impl' and not is_trait_impl and has_self and body.statements > 0")
    broken = f.where("owner = 'impl' and is_trait_impl and body.broken")
    selfless = own.where("not body.stub and not body.self_used")
    needless = own.where("mut_self and body.self_seen and not body.self_changed")
    # a type's last definition in file order answers for its name
    home = types.where("kind in ('struct', 'enum') and not in_test").groupBy(F.col("name").alias("type_name")).agg(F.max_by("file", F.struct("file", "line")).alias("home"))
    away = impls.where("trait_name is null and not in_test").join(home, "type_name").where(module_of(F.col("file")) != module_of(F.col("home")))
    by = impls.where("trait_name is not null and not in_test").groupBy("trait_name").agg(F.count("*").alias("n"), F.min("type_name").alias("only")).where("n = 1")
    single = types.where("kind = 'trait' and public <> 'pub' and methods > 0 and not in_test").join(by, F.col("name") == F.col("trait_name"))
    casts = f.select("file", F.explode("body.downcasts").alias("line"))
    errors = functions.where("owner = '' and public = 'pub' and error_type is not null and not in_test")
    mixed = sets.having_count(errors, ["file"], 2, distinct="error_type")
    out = [
        (c.check_btc, finding(broken, "srp", "BTC", F.format_string("%s of %s only says that it isn't implemented", "name", "trait_name"))),
        (c.check_slm, finding(selfless, "srp", "SLM", F.concat("name", F.lit(" takes self and doesn't use it")), "low")),
        (c.check_nms, finding(needless, "srp", "NMS", F.concat("name", F.lit(" takes self as mutable and changes nothing")), "low")),
        (c.check_oi, finding(away, "coupling", "OI", F.concat(F.lit("impl of "), "type_name", F.lit(" stands outside the module of "), "home"))),
        (c.check_sit, finding(single, "coupling", "SIT", F.concat("name", F.lit(" has one implementation: "), "only"), "low")),
        (c.check_deh, finding(casts, "coupling", "DEH", F.lit("downcast"))),
        (c.check_iet, finding(mixed, "coupling", "IET", F.format_string("%d error types in public functions", "n"), "low", line=1)),
    ]
    return union([x if on and c.enabled else x.limit(0) for on, x in out])
