"""Graph analytics and data preparation as DataFrame programs."""
