"""Fixed reference data: the reduced metabolic network, the control panel and the plan of comparison operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import MODALITIES
from ..operators.flux import Network, Reaction

#: Other names of genes.
ALIASES = {"GLUT1": "SLC2A1", "MCT1": "SLC16A1", "MCT9": "SLC16A9"}
#: Reaction, equation, gene rule, pathway, lower and upper bound.
REACTIONS = (
    ("EX_glc_D_e", "-> glc_D_e", "ENVIRONMENT", "exchange", 0.0, 10.0),
    ("EX_o2_e", "-> o2_e", "ENVIRONMENT", "exchange", 0.0, 6.0),
    ("EX_gln_e", "-> gln_e", "ENVIRONMENT", "exchange", 0.0, 2.0),
    ("EX_fa_e", "-> fa_e", "ENVIRONMENT", "exchange", 0.0, 2.0),
    ("EX_carn_e", "-> carn_e", "ENVIRONMENT", "exchange", 0.0, 5.0),
    ("EX_ser_e", "-> ser_e", "ENVIRONMENT", "exchange", 0.0, 1.0),
    ("EX_lac_e", "lac_e ->", "ENVIRONMENT", "exchange", 0.0, 1000.0),
    ("EX_co2_e", "co2_c ->", "ENVIRONMENT", "exchange", 0.0, 1000.0),
    ("EX_h2o_e", "h2o_c ->", "ENVIRONMENT", "exchange", 0.0, 1000.0),
    ("EX_gly_e", "gly_c ->", "ENVIRONMENT", "exchange", 0.0, 1000.0),
    ("DM_biomass", "biomass_c ->", "BIOMASS_MARKER", "drain", 0.0, 1000.0),
    ("GLUT1_transport", "glc_D_e -> glc_D_c", "SLC2A1", "transport", 0.0, 10.0),
    ("GLUT3_transport", "glc_D_e -> glc_D_c", "SLC2A3", "transport", 0.0, 0.2),
    ("O2_transport", "o2_e -> o2_c", "SLC25A4", "transport", 0.0, 6.0),
    ("GLN_transport", "gln_e -> gln_c", "SLC1A5", "transport", 0.0, 2.0),
    ("FA_transport", "fa_e -> fa_c", "CD36", "transport", 0.0, 2.0),
    ("CARN_transport", "carn_e -> carn_c", "SLC16A9", "transport", 0.0, 5.0),
    ("SER_transport", "ser_e -> ser_c", "SLC1A4", "transport", 0.0, 1.0),
    ("PHGDH", "p3g_c + nad_c -> php_c + nadh_c", "PHGDH", "one-carbon", 0.0, 1000.0),
    ("PSAT1", "php_c + glu_c -> pser_c + akg_c", "PSAT1", "one-carbon", 0.0, 1000.0),
    ("PSPH", "pser_c -> ser_c", "PSPH", "one-carbon", 0.0, 1000.0),
    ("HEX", "glc_D_c + atp_c -> g6p_c + adp_c", "HK2 or GCK", "glycolysis-lactate", 0.0, 1000.0),
    ("PGI", "g6p_c -> f6p_c", "GPI", "glycolysis-lactate", -1000.0, 1000.0),
    ("PFK", "f6p_c + atp_c -> fbp_c + adp_c", "PFKM or PFKP", "glycolysis-lactate", 0.0, 1000.0),
    ("ALDO", "fbp_c -> dhap_c + gap_c", "ALDOA", "glycolysis-lactate", -1000.0, 1000.0),
    ("TPI", "dhap_c -> gap_c", "TPI1", "glycolysis-lactate", -1000.0, 1000.0),
    ("GAPDH", "gap_c + nad_c -> dpg_c + nadh_c", "GAPDH", "glycolysis-lactate", 0.0, 1000.0),
    ("PGK", "dpg_c + adp_c -> p3g_c + atp_c", "PGK1", "glycolysis-lactate", 0.0, 1000.0),
    ("PGAM", "p3g_c -> p2g_c", "PGAM1", "glycolysis-lactate", -1000.0, 1000.0),
    ("ENO", "p2g_c -> pep_c", "ENO1", "glycolysis-lactate", 0.0, 1000.0),
    ("PKM", "pep_c + adp_c -> pyr_c + atp_c", "PKM", "glycolysis-lactate", 0.0, 1000.0),
    ("LDHA", "pyr_c + nadh_c -> lac_c + nad_c", "LDHA", "glycolysis-lactate", -1000.0, 1000.0),
    ("MCT1_export", "lac_c -> lac_e", "SLC16A1", "glycolysis-lactate", 0.0, 1000.0),
    ("MCT4_export", "lac_c -> lac_e", "SLC16A3", "glycolysis-lactate", 0.0, 2.0),
    ("G3P_shuttle", "nadh_c + nad_m -> nad_c + nadh_m", "GPD2", "redox-shuttle", 0.0, 1.0),
    ("PDH", "pyr_c + nad_m + coa_c -> accoa_c + nadh_m + co2_c", "PDHA1", "tca-cycle", 0.0, 1000.0),
    ("CS", "accoa_c + oaa_c -> cit_c + coa_c", "CS", "tca-cycle", 0.0, 1000.0),
    ("ACO", "cit_c -> icit_c", "ACO2", "tca-cycle", -1000.0, 1000.0),
    ("IDH", "icit_c + nad_m -> akg_c + nadh_m + co2_c", "IDH3A or IDH2", "tca-cycle", 0.0, 1000.0),
    ("OGDH", "akg_c + nad_m + coa_c -> succoa_c + nadh_m + co2_c", "OGDH", "tca-cycle", 0.0, 1000.0),
    ("SUCLA", "succoa_c + adp_c -> succ_c + atp_c + coa_c", "SUCLA2", "tca-cycle", 0.0, 1000.0),
    ("SDH", "succ_c -> mal_c", "SDHA", "tca-cycle", 0.0, 1000.0),
    ("MDH", "mal_c + nad_m -> oaa_c + nadh_m", "MDH2", "tca-cycle", 0.0, 1000.0),
    ("OXPHOS", "2 nadh_m + o2_c + 8 adp_c -> 2 nad_m + 2 h2o_c + 8 atp_c", "NDUFS1 and COX5A and ATP5F1A", "oxidative-phosphorylation", 0.0, 1000.0),
    ("CPT1A_shuttle", "carn_c + fa_c + coa_c -> acylcarn_c", "CPT1A", "fatty-acid-oxidation-carnitine-shuttle", 0.0, 1000.0),
    ("FAO_beta", "acylcarn_c + coa_c + 2 nad_m -> accoa_c + carn_c + 2 nadh_m", "ACADM or HADHA", "fatty-acid-oxidation-carnitine-shuttle", 0.0, 1000.0),
    ("ACC", "accoa_c + atp_c + co2_c -> malonyl_c + adp_c", "ACACA", "fatty-acid-synthesis", 0.0, 1000.0),
    ("FASN", "malonyl_c + 2 nadph_c -> palm_c + co2_c + coa_c + 2 nadp_c", "FASN", "fatty-acid-synthesis", 0.0, 1000.0),
    ("SCD", "palm_c + o2_c + nadph_c -> palm_unsat_c + nadp_c + h2o_c", "SCD", "ferroptosis-cholesterol", 0.0, 1000.0),
    ("ACSL4", "palm_unsat_c + coa_c + atp_c -> palm_unsat_coa_c + adp_c", "ACSL4", "ferroptosis-cholesterol", 0.0, 1000.0),
    ("LPOX", "palm_unsat_coa_c + o2_c -> lpoa_c + h2o_c", "ALOX15", "ferroptosis-cholesterol", 0.0, 1000.0),
    ("GPX4", "lpoa_c + nadph_c -> palm_unsat_coa_c + nadp_c", "GPX4", "ferroptosis-cholesterol", 0.0, 1000.0),
    ("CES1_detox", "lpoa_c -> palm_unsat_c + coa_c", "CES1", "ferroptosis-cholesterol", 0.0, 1000.0),
    ("HMGCR", "accoa_c + nadph_c -> chol_c + coa_c + nadp_c", "HMGCR", "ferroptosis-cholesterol", 0.0, 1000.0),
    ("GLS", "gln_c -> glu_c", "GLS", "glutaminolysis", 0.0, 1000.0),
    ("GLUD1", "glu_c + nad_m -> akg_c + nadh_m", "GLUD1", "glutaminolysis", 0.0, 1000.0),
    ("G6PD", "g6p_c + nadp_c -> pgl_c + nadph_c", "G6PD", "pentose-phosphate", 0.0, 1000.0),
    ("TKT", "pgl_c -> r5p_c", "TKT", "pentose-phosphate", 0.0, 1000.0),
    ("ME1", "mal_c + nadp_c -> pyr_c + nadph_c + co2_c", "ME1", "pentose-phosphate", 0.0, 1000.0),
    ("SHMT2", "ser_c -> gly_c + thf_c", "SHMT2", "one-carbon", 0.0, 1000.0),
    ("MTHFD2", "thf_c + nadp_c -> mthf_c + nadph_c", "MTHFD2", "one-carbon", 0.0, 1000.0),
    ("DHFR", "mthf_c + nadph_c -> thf_c + nadp_c", "DHFR", "one-carbon", 0.0, 1000.0),
    ("TK1", "mthf_c + adp_c -> dtmp_c + atp_c", "TK1", "nucleotide-dna-repair", 0.0, 1000.0),
    ("RRM2", "atp_c + nadph_c -> dndp_c + adp_c + nadp_c", "RRM2", "nucleotide-dna-repair", 0.0, 1000.0),
    ("NEK8_repair", "dndp_c + atp_c -> repair_c + adp_c", "NEK8", "nucleotide-dna-repair", 0.0, 1000.0),
    ("MAR09034_biomass", "atp_c + palm_c + r5p_c + dtmp_c + oaa_c + chol_c + repair_c -> adp_c + biomass_c", "BIOMASS_MARKER", "biomass", 0.0, 1000.0),
)
BIOMASS = "MAR09034_biomass"


def _side(text: str) -> list[tuple[str, float]]:
    parts = [p.split() for p in text.split(" + ") if p.strip()]
    return [(p[-1], float(p[0]) if len(p) == 2 else 1.0) for p in parts]


def reduced_network() -> Network:
    """The 66-reaction network with biomass as its objective."""
    found = []
    for name, equation, rule, pathway, low, high in REACTIONS:
        left, right = equation.split("->")
        c: dict[str, float] = {}
        for sign, side in ((-1.0, left), (1.0, right)):
            for m, n in _side(side.strip()):
                c[m] = c.get(m, 0.0) + sign * n
        found.append(Reaction(name, {m: v for m, v in c.items() if v}, rule, pathway, low, high))
    return Network(tuple(found), BIOMASS)


#: Control; alias; label; whether calibration may use it; modalities (in their order) that it supports.
CONTROLS = (
    ("SLC2A1", "GLUT1", 1, True, "KG DEP FLUX CLIN"),
    ("SLC16A1", "MCT1", 1, False, "KG DEP"),
    ("SLC16A9", "MCT9", 0, True, ""),
    ("CPT1A", None, 0, True, ""),
    ("CES1", None, 0, True, "FLUX"),
)
SUPPORTED, UNSUPPORTED, DISPERSION, PANEL_SEED = 0.82, 0.12, 0.16, 20260101


def control_scores(dispersion: float = DISPERSION, seed: int = PANEL_SEED) -> pd.DataFrame:
    """symbol, ordinal, label, calibration, modality, score: coded levels with normal noise, drawn control by control."""
    noise = np.random.default_rng(seed).normal(0.0, dispersion, (len(CONTROLS), len(MODALITIES)))
    rows = [
        (symbol, i, label, used, m, float(np.clip((SUPPORTED if m in supports.split() else UNSUPPORTED) + noise[i, j], 0.0, 1.0)))
        for i, (symbol, _, label, used, supports) in enumerate(CONTROLS)
        for j, m in enumerate(MODALITIES)
    ]
    return pd.DataFrame(rows, columns=["symbol", "ordinal", "label", "calibration", "modality", "score"])


def control_panel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(control_scores(), "symbol string, ordinal int, label int, calibration boolean, modality string, score double")


#: Number, family, modalities, aggregation, noise, calibrated, hops of the comparison operators.
OPERATORS = (
    (1, "multi_agent", ("KG", "DEP", "FLUX", "CLIN"), "tournament", 0.05, False, 0),
    (2, "multi_agent", ("KG", "DEP", "FLUX", "CLIN"), "mean", 0.05, False, 1),
    (3, "multi_agent", ("KG", "DEP"), "product", 0.04, False, 0),
    (4, "multi_agent", ("KG", "DEP", "FLUX", "CLIN"), "provenance_gated", 0.06, False, 0),
    (5, "multi_agent", ("DEP", "CLIN"), "max", 0.05, False, 0),
    (6, "multi_agent", ("FLUX",), "reviewer", 0.0, True, 0),
    (7, "multi_agent", ("KG", "DEP", "FLUX", "CLIN"), "rank_mean", 0.07, False, 2),
    (8, "multi_agent", ("KG", "FLUX"), "product", 0.04, False, 2),
    (9, "multi_agent", ("KG", "DEP", "FLUX", "CLIN"), "dual_mode", 0.05, False, 0),
    (10, "multi_agent", ("KG", "DEP", "FLUX", "CLIN"), "dual_mode", 0.03, True, 0),
    (11, "graph_embedding", ("KG",), "mean", 0.08, True, 0),
    (12, "graph_embedding", ("KG", "CLIN"), "mean", 0.07, True, 2),
    (13, "graph_embedding", ("KG", "DEP", "FLUX", "CLIN"), "mean", 0.06, True, 0),
    (14, "graph_embedding", ("KG", "DEP"), "mean", 0.06, True, 1),
    (15, "retrieval", ("KG",), "mean", 0.09, True, 0),
    (16, "retrieval", ("KG", "CLIN"), "mean", 0.08, True, 0),
    (17, "retrieval", ("KG", "FLUX"), "mean", 0.08, True, 0),
    (18, "retrieval", ("KG", "DEP", "FLUX", "CLIN"), "median", 0.07, True, 0),
    (19, "retrieval", ("KG", "CLIN"), "max", 0.07, True, 0),
    (20, "retrieval", ("KG", "DEP"), "max", 0.07, True, 0),
    (21, "retrieval", ("KG", "DEP"), "mean", 0.08, True, 0),
    (22, "retrieval", ("KG",), "median", 0.06, True, 0),
    (23, "mechanistic", ("FLUX",), "mean", 0.0, False, 0),
    (24, "mechanistic", ("FLUX",), "rank_mean", 0.05, True, 0),
    (25, "mechanistic", ("FLUX", "CLIN"), "product", 0.04, True, 0),
    (26, "mechanistic", ("FLUX",), "mean", 0.06, True, 1),
    (27, "mechanistic", ("FLUX",), "max", 0.06, True, 1),
    (28, "mechanistic", ("FLUX",), "min", 0.05, False, 0),
    (29, "mechanistic", ("FLUX",), "mean", 0.0, True, 0),
    (30, "single_llm", ("DEP",), "mean", 0.08, False, 0),
    (31, "single_llm", ("FLUX", "CLIN"), "mean", 0.07, False, 0),
    (32, "single_llm", ("CLIN",), "mean", 0.08, False, 0),
    (33, "single_llm", ("KG", "DEP", "FLUX", "CLIN"), "min", 0.06, False, 0),
    (34, "transcriptomic", ("CLIN",), "mean", 0.05, True, 0),
    (35, "transcriptomic", ("CLIN",), "mean", 0.05, True, 1),
    (36, "transcriptomic", ("CLIN",), "max", 0.05, True, 0),
    (37, "transcriptomic", ("CLIN",), "median", 0.05, True, 0),
    (38, "fusion_control", ("KG", "DEP", "FLUX", "CLIN"), "rank_mean", 0.0, False, 0),
    (39, "fusion_control", ("KG", "DEP", "FLUX", "CLIN"), "mean", 0.1, False, 0),
)


def operator_plan() -> list[tuple[int, str, list[str], str, float, bool, int]]:
    return [(number, family, list(modalities), *rest) for number, family, modalities, *rest in OPERATORS]
