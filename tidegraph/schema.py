"""Schemas of the tables that the library reads and writes."""

from __future__ import annotations

EDGES = "net_id string, t int, src int, dst int, y tinyint"
NODES = "net_id string, node int, name string"
STEPS = "net_id string, t int, label string"
POSITIONS = "t int, node int, x array<double>"
LABELS = "t int, node int, z int"
CLUSTERS = "k int, mu array<double>, sigma double"
RADII = "node int, r double"
EDGE_LIST = "Source string, Target string, Weight int, Season int"

RUN = "run_id string, chain int, iter int"
SAMPLES = {
    "scalar": f"{RUN}, logp double, b_in double, b_out double, lambda double, tau_sq double, b double, gamma double, alpha0 double, alpha double, kappa double",
    "position": f"{RUN}, t int, node int, x array<double>",
    "label": f"{RUN}, t int, node int, z int",
    "cluster": f"{RUN}, k int, mu array<double>, sigma double, beta double",
    "init": f"{RUN}, k int, w double",
    "trans": f"{RUN}, t int, k_from int, k_to int, w double",
    "radius": f"{RUN}, node int, r double",
    "missing": f"{RUN}, t int, src int, dst int, y int",
}
