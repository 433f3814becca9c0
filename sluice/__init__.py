"""sluice: DataFrame programs for catalog, activity and text-corpus analytics."""
