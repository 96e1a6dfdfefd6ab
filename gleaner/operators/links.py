"""Repeating link containers of a page.

Everything here works on the `nodes` array of one page (see `sources.dom`), as
plain column expressions: the work of a page stays in its scan task, so neither
page text nor nodes are ever shuffled, and no source can become a hot key.

Groups are runs of a sorted array, so the cost is linear in links x depth
(after one sort), not quadratic in the links of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions import values as v
from gleaner.functions.text import let


def node_at(nodes: Column, nid: Column) -> Column:
    return F.get(nodes, nid)


def path_to(nodes: Column, nid: Column) -> Column:
    """nids from the root down to a node. Paths are made for the few nodes that
    need one; carrying them in every node would cost nodes x depth."""
    up = F.aggregate(
        F.sequence(F.lit(1), node_at(nodes, nid).depth),
        F.array(nid),
        lambda path, _: F.concat(path, F.array(node_at(nodes, F.element_at(path, -1)).parent)),
    )
    return F.when(node_at(nodes, nid).depth == 0, F.array(nid)).otherwise(F.reverse(up))


def is_element(n: Column) -> Column:
    return n.kind == "element"


def atom(tag: Column) -> Column:
    """Tag name for comparing tag paths: all unknown tags count as ''."""
    return F.when(tag.isin(v.HTML_TAGS), tag).otherwise("")


def inline(tag: Column) -> Column:
    return tag.isin(v.INLINE_TAGS)


def anchors(nodes: Column) -> Column:
    """nids of all `a` elements, in document order."""
    return F.transform(
        F.filter(nodes, lambda n: is_element(n) & (n.tag == "a")), lambda n: n.nid
    )


def tag_path_signature(nodes: Column, anc: Column) -> Column:
    """MD5 of the tags from an element up to the child of body (or head)."""
    tags = F.transform(
        F.slice(anc, F.lit(3), F.greatest(F.size(anc) - 2, F.lit(0))),
        lambda a: atom(node_at(nodes, a).tag),
    )
    return F.md5(F.when(F.size(anc) == 1, "html").otherwise(F.array_join(F.reverse(tags), "")))


def link_groups(nodes: Column, link_nids: Column) -> Column:
    """Links grouped by tag path:
    ARRAY<STRUCT<sig, min_depth, links: ARRAY<STRUCT<sig, nid, depth, anc, href>>>>,
    links in document order."""

    def link(nid):
        return let(
            path_to(nodes, nid),
            lambda path: F.struct(
                tag_path_signature(nodes, path).alias("sig"),
                nid.alias("nid"),
                (F.size(path) - 1).alias("depth"),
                path.alias("anc"),
                F.element_at(node_at(nodes, nid).attrs, "href").alias("href"),
            ),
        )

    def split_runs(links):
        starts = F.filter(
            F.transform(
                links,
                lambda x, i: F.when(
                    (i == 0) | (F.get(links, i - 1).sig != x.sig), i
                ),
            ),
            lambda i: i.isNotNull(),
        )

        def runs(starts):
            return F.transform(
                starts,
                lambda s, k: F.slice(
                    links, s + 1, F.coalesce(F.get(starts, k + 1), F.size(links)) - s
                ),
            )

        return let(starts, runs)

    ordered = F.sort_array(F.transform(link_nids, link))
    return F.transform(
        let(ordered, split_runs),
        lambda g: F.struct(
            F.get(g, F.lit(0)).sig.alias("sig"),
            F.array_min(F.transform(g, lambda x: x.depth)).alias("min_depth"),
            g.alias("links"),
        ),
    )


def container_levels(nodes: Column, group: Column) -> Column:
    """Candidate containers of a group, one entry per level; level 0 is at the
    depth of the shallowest link, each next level is one step nearer the root:
    ARRAY<STRUCT<level, containers: ARRAY<INT>, repeating>>."""
    depth = group.min_depth

    def level(d):
        containers = F.transform(group.links, lambda x: F.get(x.anc, depth - d))
        return let(
            containers,
            lambda c: F.struct(
                d.alias("level"), c.alias("containers"), repeating(nodes, c).alias("repeating")
            ),
        )

    # sequence() counts down when its end is below its start
    levels = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(levels, level)


def repeating(nodes: Column, containers: Column) -> Column:
    """Whether containers are all different nodes with one and the same tag.

    At one depth the links below a node are a contiguous run in document order,
    so "all different" is the same as "neighbours differ".
    """
    tags = F.transform(containers, lambda c: atom(node_at(nodes, c).tag))
    return (F.size(F.array_distinct(containers)) == F.size(containers)) & (
        F.size(F.array_distinct(tags)) == 1
    )


def highest_level(levels: Column) -> Column:
    """The entry of `container_levels` to use, or NULL: the level whose number
    is the count of repeating levels less one, if that level repeats."""
    return let(
        F.size(F.filter(levels, lambda x: x.repeating)),
        lambda n: let(
            F.get(levels, F.when(n > 0, n - 1)),
            lambda x: F.when(x.repeating, x),
        ),
    )


def highest_containers(nodes: Column, groups: Column) -> Column:
    """Links with their containers over all groups of a page:
    ARRAY<STRUCT<sig, link_nid, container_nid, href>>."""

    def of_group(g):
        return let(
            highest_level(container_levels(nodes, g)),
            lambda x: F.when(
                x.isNotNull(),
                F.transform(
                    g.links,
                    lambda link, i: F.struct(
                        g.sig.alias("sig"),
                        link.nid.alias("link_nid"),
                        F.get(x.containers, i).alias("container_nid"),
                        link.href.alias("href"),
                    ),
                ),
            ),
        )

    return F.flatten(F.filter(F.transform(groups, of_group), lambda g: g.isNotNull()))
