"""Building blocks shared by the plans: joins, row selection, measures, reshaping."""
