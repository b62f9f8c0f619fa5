from cinnabar.cli import run

run()
