"""Physical building blocks: joins, paths, rules, shapes, temporal and matching operators."""
