"""DataFrame operators.  Each takes DataFrames and returns a lazy DataFrame,
except the Spark ML fits in ``profile``, which run jobs when called."""

from panelcast.operators.adoption import (
    Family,
    adoption_families,
    adoption_vs_demand,
    distinct_entities,
    entity_sketches,
    merged_sketches,
    sketch_counts,
)
from panelcast.operators.association import association_grid, contingency, cramers_v, top_associations
from panelcast.operators.fanout import Bridge, FanoutBase, decode, fanout_base, fanout_breakdowns, grouped_avg, histogram, histogram_nice
from panelcast.operators.flow import bridge_weights, flow_graph, flow_links, flow_nodes, forked_flows, label_counts, pair_flows, pathway
from panelcast.operators.profile import (
    Clusters,
    Components,
    array_vectors,
    cluster_profiles,
    distinct_vectors,
    fit_clusters,
    indicator_long,
    indicator_vectors,
    indicator_wide,
    normalized,
    principal_components,
    project_2d,
    second_moments,
    silhouette,
    silhouette_sweep,
)
from panelcast.operators.share import breakdown, collapse_small, distribution, equals, group_share, pivot_share

__all__ = [
    "Bridge",
    "Clusters",
    "Components",
    "Family",
    "FanoutBase",
    "adoption_families",
    "adoption_vs_demand",
    "array_vectors",
    "association_grid",
    "breakdown",
    "bridge_weights",
    "label_counts",
    "cluster_profiles",
    "collapse_small",
    "contingency",
    "cramers_v",
    "decode",
    "distinct_entities",
    "distinct_vectors",
    "distribution",
    "entity_sketches",
    "equals",
    "fanout_base",
    "fanout_breakdowns",
    "fit_clusters",
    "flow_graph",
    "flow_links",
    "flow_nodes",
    "forked_flows",
    "group_share",
    "grouped_avg",
    "histogram",
    "histogram_nice",
    "indicator_long",
    "indicator_vectors",
    "indicator_wide",
    "merged_sketches",
    "normalized",
    "pair_flows",
    "pathway",
    "pivot_share",
    "principal_components",
    "project_2d",
    "second_moments",
    "silhouette",
    "silhouette_sweep",
    "sketch_counts",
    "top_associations",
]
