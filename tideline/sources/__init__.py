"""Tables and the views that present them as games, ticks, player statistics, injuries and snapshots."""
