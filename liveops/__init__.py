"""Analysis of live-media services on Spark: catalogs, fleets, channels, packets, playlists."""
